"""Statistics, counts and stages against plain rules over whole texts."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from recallspark.llm import decontamination, idfile, quality, token_counts
from recallspark.llm.encoding import vocabulary

ODD = ["", " ", "one", "  lead and trail  ", "A B C! 12 $x ALL CAPS caps", "same same same other same", "# $ % ^ & ** ok", "é漢字 🙂 É", "x\ty\nz  w", "UP UP down $ $ $ UP"]


def plain_statistics(text):
    raw = text.encode()
    tokens = re.split(r"[\t\n\f\r ]+", text)
    words = [w for w in tokens if w]
    share = lambda of, whole: math.log(quality.FLOOR + of / max(whole, 1))
    out = [math.log1p(len(raw)), math.log1p(len(words)), math.log1p(sum(len(w.encode()) for w in words) / max(len(words), 1))]
    out += [share(sum(b in chars for b in raw), len(raw)) for chars in quality.CLASSES.values()]
    counts = collections.Counter(tokens)
    same = [i > 0 and tokens[i] == tokens[i - 1] for i in range(len(tokens))]
    out += [share(len(counts), len(words)), share(max(counts.values()), len(words)), share(sum(same), len(words))]
    marked = [any(b in quality.CLASSES["symbol"] for b in w.encode()) for w in tokens]
    lower = lambda b: 97 <= b <= 122 or b >= 128
    loud = [not any(map(lower, w.encode())) and any(65 <= b <= 90 for b in w.encode()) for w in tokens]
    out += [share(sum(marked), len(words)), share(sum(loud), len(words))]
    longest = run = 0
    for junk in (a or b or c for a, b, c in zip(marked, loud, same, strict=True)):
        run = run + 1 if junk else 0
        longest = max(longest, run)
    return [*out, math.log1p(longest)]


def texts_of(spark, sf_dir):
    return [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


def test_quality_statistics(spark, sf_dir):
    texts = ODD + texts_of(spark, sf_dir) + ODD
    got = quality.statistics(pa.array(texts, pa.large_string()))
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_token_counts_of_whole_texts(spark, sf_dir):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    path = vocabulary("piece_bpe_32k.model")
    pieces, _ = token_counts.pieces_of(path)
    library = Tokenizer(Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces], unk_id=0, byte_fallback=True))
    texts = [t[:20_000] for t in texts_of(spark, sf_dir)[:80]] + ODD
    got = token_counts.counter(path).of_texts(pa.array(texts, pa.large_string())).tolist()
    assert got == [len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for t in texts]


def shingles(text):
    w = [x for x in re.split(r"[^\w]|_", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_leaking_documents_go(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = [s for s in (shingles(r.text or "") for r in items.collect()) if s]
    own = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    clean = {d for d, s in own.items() if not any(len(s & h) >= math.ceil(round(0.8 * len(h), 6)) for h in held)}
    assert {r.doc_id for r in decontamination.without_leaks(docs, items).collect()} == clean and len(clean) < len(own)


def test_a_damaged_list_of_documents_fails_the_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    idfile.write_ids(docs, f"{tmp_path}/ids", vocabulary("byte_bpe_50k.json"))
    stored = spark.read.parquet(f"{tmp_path}/ids").collect()
    bad = [r.asDict() | {"docs": r.docs[:-1] + bytes([r.docs[-1] ^ 1])} for r in stored]
    spark.createDataFrame(bad, idfile.SEGMENT_SCHEMA).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="Corrupt|list of documents"):
        idfile.read_ids(spark, f"{tmp_path}/bad").collect()
