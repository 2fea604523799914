"""Text functions against literal cases and a plain rule."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from recallspark.functions import text as t


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, x string").orderBy("i").select(column).collect()]


def test_stems(spark):
    cases = {"cat": "cat", "flies": "fli", "tried": "tri", "glasses": "glass", "kindness": "kind", "movement": "move", "running": "runn", "motion": "mot", "readable": "read", "visible": "vis", "hopeful": "hope", "famous": "fam", "active": "act", "quickly": "quick", "walked": "walk", "walker": "walk", "boxes": "box", "dogs": "dog", "glass": "glass", "able": "able"}
    assert dict(zip(cases, values(spark, list(cases), t.stem(F.col("x"))), strict=True)) == cases


def test_terms_and_addresses(spark):
    assert values(spark, ["How does the Prompt cache TTL cache_key work", "a of"], t.content_terms(F.col("x"))) == [["prompt", "cache", "ttl", "cache_key", "work"], []]
    assert values(spark, [" ExecPlan::My-Plan ", "two words: no", "none"], t.address(F.col("x"))) == ["execplan:my-plan", None, None]
    assert values(spark, ["B-2 a_b c B-2"], t.query_terms(F.col("x"))) == [["a_b", "b-2"]]


def plain_chunks(text):
    text = text.strip()
    if len(text) <= t.CHUNK:
        return [text] if text else []
    out, start = [], 0
    while start < len(text):
        ideal = min(start + t.CHUNK, len(text))
        end = ideal
        if ideal < len(text):
            reach = range(ideal, start + t.CHUNK_LEAST - 1, -1)
            end = next((c for c in reach if text[c - 2 : c] == "\n\n"), ideal)
            if end == ideal:
                end = next((c for c in reach if text[c - 1].isspace()), ideal)
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end == len(text):
            return out
        start = end - t.CHUNK_OVERLAP
    return out


def test_chunks(spark):
    rng = random.Random(5)
    texts = ["", "  short ", "x" * 5000, "word " * 2000, "漢" * 1801]
    texts += ["".join(rng.choice(["ab", "cde", "f"]) * rng.randint(1, 400) + rng.choice([" ", "\n\n", "\n", "  "]) for _ in range(40)) for _ in range(12)]
    assert values(spark, texts, t.chunks(F.col("x"))) == [plain_chunks(x) for x in texts]


def test_sections_summaries_facts_and_redaction(spark):
    text = "intro\n# One\nbody\n## Two\n\n"
    assert values(spark, [text, " \n"], t.markdown_sections(F.col("x"))) == [["intro\n", "# One\nbody\n", "## Two\n\n"], []]
    said = "First one. Nothing here. We decided to go. More words follow. The end."
    assert values(spark, [said, said, None], t.summary(F.col("x"), 60)) == ["First one. We decided to go. The end."] * 2 + [""]
    assert values(spark, [said], t.summary(F.col("x"), 20)) == ["First one. The end."]
    found = values(spark, ["Paid $450,000 on 2024-01-05 and $450,000; v1.2.3 had 12 users by March 3, 2024"], t.stated_facts(F.col("x")))[0]
    assert {(f.kind, f.object) for f in found} == {("money", "$450,000"), ("date", "2024-01-05"), ("version", "v1.2.3"), ("count", "12 users"), ("month_date", "march 3, 2024")} and len(found) == 5
    assert values(spark, ["mail a.b@c.org from 10.0.0.1 token=abc"], t.log_redacted(F.col("x"))) == ["mail [EMAIL] from [IP] token=[REDACTED]"]
