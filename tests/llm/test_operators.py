"""The ten training-data operators against SQL, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import same_as_sql

from recallspark.llm import bagminhash, chat, common, decontamination, idfile, minhash, packing, quality, queries, sharding, token_counts, toxicity, vectors
from recallspark.llm.encoding import vocabulary

DOCS = "doc_id long, text string, conv_id string, w int, shard int, score string"
LONG = "word " * 30000 + "end"
ODD = [(3, None, None, 1, 1, "x"), (1, "", "a", 2, 2, "y"), (2, LONG, None, None, None, None), (5, "one two", "b", 1, 1, "z"), (5, "one two", "b", 1, 1, "z"), (6, "  \t\n é漢字 <|endoftext|>  x", "c", 0, 0, ""), (7, "the same five words again here", "d", 0, 0, ""), (8, "the same five words again here", "d", 0, 0, "")]
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, sf_dir, name):
    same_as_sql(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


END_MARK = "<|endoftext|>"
MARKED = [END_MARK, f"x{END_MARK}y", f"x {END_MARK}", f"{END_MARK} x", f"a  {END_MARK}  b", f"{END_MARK}{END_MARK}", f"a\n{END_MARK}\n b", f"<|startoftext|>a B{END_MARK}", f"{END_MARK.upper()} <|end", f"don't{END_MARK}'t {END_MARK} {END_MARK}"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoding_is_that_of_the_untouched_library(name, spaced):
    import pyarrow as pa

    from recallspark.llm.encoding import Encoder

    plain, own = tokenizer(name), Encoder(vocabulary(name), spaced, most_pieces=20)  # its store is trimmed all the time
    texts = MARKED + [r[1] or "" for r in ODD] + ["", " ", "  lead", "trail  ", "tab\t x", "é漢字🙂 ok"]
    for some in (texts, texts[::-1], texts):
        ids, at = own.encode(pa.array(some, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in some]


def test_words_are_encoded_without_the_marks_that_follow_them():
    import pyarrow as pa

    from recallspark.llm.encoding import Encoder

    plain, own = tokenizer("byte_bpe_50k.json"), Encoder(vocabulary("byte_bpe_50k.json"), True)
    words, marks = [f"{a}{b}" for a in ("ing", "été", "Th", "or") for b in ("tion", "né", "x7", "le")], [",", ".", ".\nIn", "&&&", "'s", "'tis", "\n\n", " \n", "\n ", "\t", "×", "²", "(a", "<|x"]
    texts = ["".join(f" {w}{m}" for w in words for m in marks[k:] + marks[:k]) for k in range(len(marks))]
    ids, at = own.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    own = Encoder(vocabulary("byte_bpe_50k.json"), True)
    own.encode(pa.array([" ".join(f"{w}{m}" for w in words for m in (",", ".", ";", "&&&", "!"))], pa.large_string()))
    assert len(own.index) <= 2 * len(words) + 6  # not each word with each mark


def check_ids(found, docs):
    t = tokenizer("byte_bpe_50k.json")
    want, start = [], 0
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == want


def test_token_ids(spark, sf_dir, odd, none):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_ids(queries.op1_token_id_output(spark, sf_dir).collect(), docs)
    path = vocabulary("byte_bpe_50k.json")
    check_ids(idfile.encode_documents(odd, path).collect(), [r[:2] for r in ODD])
    assert idfile.encode_documents(none, path).count() == 0
    same = spark.range(400).selectExpr("id % 2 AS doc_id", "repeat('a b ', int(id)) AS text")  # two keys hold all rows
    rows = idfile.encode_documents(same, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [0] * 200 + [1] * 200
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


def test_blocks_round_trip_and_reset():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 50257, n).astype(np.uint32) for n in (1, 2, 4096, 700)] + [np.full(4096, 9, np.uint32), np.array([2**32 - 1, 0, 7], np.uint32), np.tile(np.arange(40, dtype=np.uint32), 100)]
    coded = idfile.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(idfile.decode_blocks(coded), blocks, strict=True))
    assert np.array_equal(idfile.decode_blocks([coded[3]])[0], blocks[3])  # without any other block
    assert len(coded[4]) < 200 and len(coded[6]) < 1000
    broken = bytearray(coded[2])
    broken[-40] ^= 1
    with pytest.raises(idfile.Corrupt):
        idfile.decode_blocks([bytes(broken)])
    with pytest.raises(idfile.Corrupt):
        idfile.decode_blocks([coded[2][:-3]])


def test_a_block_damaged_anywhere_fails_and_many_lanes_agree_with_few():
    rng = np.random.default_rng(2)
    blocks = [rng.zipf(1.3, n).clip(max=60000).astype(np.uint32) for n in rng.integers(1, 700, 40)]
    coded = idfile.encode_blocks(blocks)
    assert [idfile.encode_blocks([b])[0] for b in blocks] == coded
    assert all(np.array_equal(a, b) for a, b in zip(idfile.decode_blocks(coded[::-1]), blocks[::-1], strict=True))
    longest = max(coded, key=len)
    for at in range(0, len(longest), 7):
        broken = bytearray(longest)
        broken[at] ^= 1 << at % 8
        try:
            got = idfile.decode_blocks([bytes(broken)])
        except idfile.Corrupt:
            continue
        assert np.array_equal(got[0], blocks[coded.index(longest)])  # bits beyond the last id


def check_packed(rows, docs, window=2048):
    t = tokenizer("word_bpe_49k.json")
    want = collections.Counter()
    by_doc, taken = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        taken[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs:
        want[doc_id] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
    assert {d: sum(r.length for r in rs) for d, rs in by_doc.items()} == dict(want)
    single = [d for d, n in collections.Counter(d for d, _ in docs).items() if n == 1]
    texts = dict(docs)
    for d in single:
        ids, at = [*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    return len(taken) * window / max(1, sum(want.values()))


def test_packing(spark, sf_dir, odd, none):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check_packed(queries.op4_packing(spark, sf_dir).collect(), docs) < 1.2
    path = vocabulary("word_bpe_49k.json")
    check_packed(packing.pack_documents(odd, path).collect(), [r[:2] for r in ODD])
    assert packing.pack_documents(none, path).count() == 0
    whole = packing.sequences(packing.pack_documents(odd, path, with_ids=True)).collect()
    assert all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in whole)


def test_tightest_fit_is_best_fit():
    rng = np.random.default_rng(3)
    fits, plain = packing.TightestFit(64), []
    for n, need in enumerate(rng.integers(1, 64, 500).tolist()):
        want = min((c for c in plain if c >= need), default=None)
        got = fits.take(need)
        assert (got and got[0]) == want
        if want is not None:
            plain.remove(want)
        left = (want or 64) - need
        if left:
            plain.append(left)
            fits.put(left, n)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\b<c>[INST] \\s\\l </s>", 5), (1, 1, "assistant", "<|end|>\n[/INST]", 5), (1, 2, "assistant", None, 5), (2, None, None, "", 5), (None, 1, "as>|>\nsistant", "x", 5), (None, 1, "assistant", "漢🙂", 5), (None, 1, "assistant", "漢🙂", 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    for conv in (1, 2, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = chat.example_texts(turns).where("conv_id = 1").orderBy("example").collect()
    assert len(made) == 2 and made[1].context.startswith(made[0].context + made[0].target) and made[1].target == chat.END
    assert chat.digests(turns.limit(0)).count() == 0


def test_chat_examples_against_sql(spark, duck, sf_dir):
    """Every assistant turn is an example whose context is all before it, in a conversation of many turns too."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = chat.expanded(chat.format_turns(turns)).where("target is not null").select("conv_id", "turn_number", "context_end", "target")
    said = "replace(replace(replace({}, '\\', '\\s'), '<', '\\l'), '[', '\\b')".format
    same_as_sql(own, duck, f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
      f AS (SELECT *, row_number() OVER w - 1 AS turn_number, '<|' || replace({said('role')}, '>', '\\g') || '|>' || chr(10) AS head, {said('text')} || '<|end|>' || chr(10) AS target FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
      SELECT conv_id, turn_number, target, CAST(context_end AS BIGINT) AS context_end FROM (SELECT *, length(head) + coalesce(sum(length(head) + length(target)) OVER (PARTITION BY conv_id ORDER BY turn_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS context_end FROM f) WHERE role = 'assistant'""")
    many = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'t' || id AS text")
    row = chat.digests(many).first()
    loss = "".join(f"t{i}" for i in range(1, 3000, 2))
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (3000, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_token_counts_match_the_library(spark, odd, none):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    path = vocabulary("piece_bpe_32k.model")
    pieces, byte_pieces = token_counts.pieces_of(path)
    assert byte_pieces
    vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces]
    library = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=True))
    texts = [r[1] or "" for r in ODD if r[1] != LONG] + ["plain words here", "a  b   c ", "漢字かな́", "x" * 300, "aaab aaab", "🙂🙂 ok🙂"]
    own = token_counts.counter(path)
    import pyarrow as pa

    got = own.of_texts(pa.array(texts, pa.large_string())).tolist()
    assert got == [len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for t in texts]
    rows = token_counts.count_tokens(odd, path).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 3)} == {0}
    assert token_counts.count_tokens(none, path).count() == 0


def test_viterbi_ties():
    same = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -3.0), ("bc", -3.0)]
    c = token_counts.Counter(same, False)
    assert c.count("ab") == 1  # equal scores: the earliest start stays
    assert c.count("abc") == 2
    assert c.count("azzb") == 3  # one run of unknown characters is one token


def test_sharding(spark, odd, none):
    rows, shards = sharding.assign(odd, 20)
    placed, listed = rows.collect(), {r.shard: r for r in shards.collect()}
    assert len(placed) == len(ODD)
    for shard, r in listed.items():
        own = [p for p in placed if p.shard == shard]
        assert sum(p.n_bytes for p in own) == r.n_bytes and (r.n_bytes <= 20 or len(own) == 1)
    assert sharding.assign(none, 20)[0].count() == 0
    many = spark.range(3000).selectExpr("id % 3 AS doc_id", "'0123456789' AS text")  # few keys
    assert sharding.assign(many, 100)[1].agg({"n_bytes": "max"}).first()[0] <= 100


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    docs = odd.unionByName(odd)  # every id twice or more, a column named shard
    listed = {"s" + r.shard: r for r in sharding.write_shards(docs, 40, f"{tmp_path}/out").collect()}
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*odd.columns, "_shard"]
    assert sorted(map(repr, back.drop("_shard").collect())) == sorted(map(repr, docs.collect()))
    size = collections.Counter()
    for r in back.collect():
        size[r._shard] += len((r.text or "").encode())
    assert dict(size) == {k: r.n_bytes for k, r in listed.items()}


@pytest.mark.parametrize("module,label,modulus,remainder", [(quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_classifiers(spark, module, label, modulus, remainder, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = {r.doc_id: r for r in module.score(docs, labels).collect()}
    assert len(scored) == docs.count()
    for d, r in scored.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [(scored[r.doc_id], r[label]) for r in labels.collect() if r[label] is not None and r.doc_id in scored and scored[r.doc_id].held_out]
    positive, negative = ([s.score for s, y in known if y == k] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in positive for n in negative])
    assert auc > 0.9, auc
    # a score follows from the text alone, and held-out labels don't matter
    other = labels.where(f"crc32(cast(doc_id as string)) % {modulus} <> {remainder}")
    again = {r.doc_id: r.score for r in module.score(docs.drop("lang", "source"), other).collect()}
    assert all(abs(again[d] - scored[d].score) < 1e-9 for d in scored)
    few = spark.createDataFrame([(1, 1, 1, "x"), (None, 0, 0, None), (2, None, None, None), (5, 7, 7, None)], LABELS)
    assert module.score(odd, few).count() == len(ODD)
    assert module.score(odd, few.limit(0)).count() == len(ODD)
    assert module.score(none, few).count() == 0


def test_shrunk_discriminant_by_hand():
    rng = np.random.default_rng(5)
    x = {c: rng.normal(c, 1 + c, (300, 3)) for c in (0, 1)}
    model = quality.factors({c: (300.0, x[c].sum(0), x[c].T @ x[c]) for c in (0, 1)})
    cov = {c: np.cov(x[c].T, bias=True) for c in (0, 1)}
    pooled = (cov[0] + cov[1]) / 2
    pooled = (1 - quality.DIAGONAL) * pooled + quality.DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(3)

    def density(c, v):
        s = (1 - quality.SHRINK) * cov[c] + quality.SHRINK * pooled
        d = v - x[c].mean(0)
        return -0.5 * (np.linalg.slogdet(s)[1] + d @ np.linalg.solve(s, d))

    v = rng.normal(0.5, 1, (5, 3))
    assert np.allclose(quality.log_density_difference(model, v), [density(1, r) - density(0, r) for r in v])


def components_of(n, links):
    top = list(range(n))
    for a, b in links:
        a, b = top[a], top[b]
        top = [min(a, b) if t in (a, b) else t for t in top]
    return top


@pytest.mark.parametrize("small", [False, True])
def test_near_vectors(spark, monkeypatch, small):
    if small:  # the ways beyond the bounds: shuffled joins, hot keys, cells cut into blocks
        for module, name, value in ((common, "FEW_KEYS", -1), (common, "HOT_ROWS", 5), (vectors, "BLOCK", 4)):
            monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    v = np.vstack([base + rng.normal(scale=0.12, size=base.shape) for _ in range(8)] + [base[:5]])
    rows = [(i, [float(f) for f in r], i % 3) for i, r in enumerate(v.astype(np.float32))]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (0, rows[0][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == n + 5 and all(got[n + k].n_links == 0 and got[n + k].kept for k in range(5))
    x = v.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(n, dtype=bool)
    want = near.sum(1)
    have = np.array([got[i].n_links for i in range(n)])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
    top = components_of(n, zip(*np.nonzero(near), strict=True))
    assert np.mean([got[i].component_id == top[i] for i in range(n)]) > 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in range(n))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def bag(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def weighted(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(docs):
    bags = [bag(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if bags[i] and bags[j] and weighted(bags[i], bags[j]) >= 0.8]
    return [docs[t][0] for t in components_of(len(docs), links)]


def test_near_duplicates(spark, sf_dir, odd, none):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 4000)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    for k in range(150):  # a star: most are near the base, few near each other
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 5)):
            own[at] = f"x{k}-{at}".replace("-", "y")
        docs.append((10_000 + k, " ".join(own)))
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = brute_classes(docs)
    assert [got[d] for d, _ in docs] == want
    rows = minhash.classes(odd).collect()
    assert {r.doc_id: r.class_id for r in rows} == {1: 1, 2: 2, 3: 3, 5: 5, 6: 6, 7: 7, 8: 7}
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 7]
    assert minhash.classes(none).count() == 0


def test_near_duplicates_beyond_the_bounds(spark, monkeypatch):
    """One large group of copies and one of near copies, with shuffled joins, hot keys, buckets in blocks and salted groups."""
    rng = np.random.default_rng(17)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    docs = [(k, " ".join(base)) for k in range(40)]
    for k in range(60):
        own = list(base)
        own[int(rng.integers(0, 120))] = f"x{k}"
        docs.append((100 + k, " ".join(own)))
    docs += [(200 + k, " ".join(f"u{k}y{i}" for i in range(30))) for k in range(10)]
    for module, name, value in ((common, "FEW_KEYS", -1), (common, "HOT_ROWS", 5), (common, "BROADCAST_ROWS", -1), (minhash, "BLOCK", 8), (minhash, "SALT", 7)):
        monkeypatch.setattr(module, name, value)
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert [got[d] for d, _ in docs] == brute_classes(docs)


def test_recall_of_lattice_cells():
    """In the table's dimension, pairs of cosine 0.9 meet in a cell, unrelated ones hardly ever."""
    from recallspark.llm import lattice

    rng = np.random.default_rng(19)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    off = rng.normal(size=a.shape)
    off -= (off * a).sum(1)[:, None] * a
    off /= np.linalg.norm(off, axis=1)[:, None]
    planes = lattice.projections(64)
    of = lambda x: lattice.cells(x, planes)
    meet = lambda x, y: ((x == y[:, :, :1]).any(axis=2) | (y == x[:, :, :1]).any(axis=2)).any(axis=1)
    cells = of(a)
    assert meet(cells, of(0.9 * a + (1 - 0.81) ** 0.5 * off)).mean() >= 0.95
    assert meet(cells, of(0.95 * a + (1 - 0.9025) ** 0.5 * off)).mean() >= 0.995
    far = np.mean([meet(cells, np.roll(cells, k, axis=0)).mean() for k in range(1, 60)])
    assert far < 3e-4, far


def test_signatures_and_sketches_estimate_weighted_jaccard():
    rng = np.random.default_rng(13)
    a, b = ({int(e): int(c) for e, c in zip(rng.integers(0, 1 << 40, 600), rng.integers(1, 9, 600), strict=True)} for _ in range(2))
    b |= {e: max(1, c - e % 2) for e, c in list(a.items())[:400]}
    pair = [(np.array(sorted(x), np.int64), np.array([x[e] for e in sorted(x)])) for x in (a, b)]
    truth = bagminhash.weighted_jaccard(*pair)
    e, c = np.concatenate([p[0] for p in pair]), np.concatenate([p[1] for p in pair])
    sig = bagminhash.signatures(np.repeat([0, 1], [len(a), len(b)]), e.view(np.uint64), c, 2)
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.2
    s = [bagminhash.sketch(*p) for p in pair]
    common, total = bagminhash.overlaps(s[0], [s[1], s[0]])
    assert abs(common[0] / total[0] - truth) < 0.06 and common[1] == total[1]


def test_leaks(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"before {LONG} {item} after", 1), (2, item.replace("kappa", "x"), 2), (3, "alpha beta gamma", 3), (4, None, 4), (5, "Two  WORDS", 5), (None, item, 6)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, "two words", 0), (3, None, 0), (4, "", 0), (None, item, 0)], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id, r.found_shingles, r.item_shingles) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {(1, 1, 6, 6), (2, 1, 5, 6), (5, 2, 1, 1)}
    left = decontamination.without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.item_id for r in left.collect()) == [3, 4, 6]
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0 and decontamination.find_leaks(docs.limit(0), items).count() == 0


def test_pipeline(spark, sf_dir, odd, none):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    rejected = [lambda d: {r.doc_id for r in toxicity.score(d, labels).where("predicted = 1").collect()}, lambda d: {r.doc_id for r in quality.score(d, labels).where("predicted = 0").collect()}]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for k, (_, stage) in enumerate(p.STAGES[:4]):
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns
        left = p.written(left, f"stage{k}")
        after = {r.doc_id for r in left.collect()}
        if k < 2:
            assert after == before - rejected[k](docs)
        if k == 2:
            own = sorted((r.doc_id, r.text) for r in docs.collect())
            assert after == {c for c in brute_classes(own)}
        docs, before = left, after
    packed = p.STAGES[4][1](spark, docs, sf_dir)
    check_packed(packed.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    whole = p.run(spark, sf_dir)
    assert sorted(map(repr, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(repr, packed.select("doc_id", "start", "length", "ids_crc32").collect()))
    for _, stage in p.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
        stage(spark, odd, sf_dir).collect()
