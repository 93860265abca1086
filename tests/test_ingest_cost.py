"""What ingest computes: each answer once, windows cut once; white space, digits and fences as before."""

import re
import sys

from pyspark.sql import functions as F

from lorewright.functions import text as X
from lorewright.operators import chunk, extract


def test_answers_are_parsed_once(spark):
    chunks = spark.createDataFrame([(1, 0, "Alpha has 3. Beta is here.")], "doc_id bigint, chunk_idx int, content string")
    rows = extract.extract(chunks)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    x = rows.first().x
    assert [f.statement for f in x.facts] == ["Alpha has 3"] and [c.statement for c in x.claims] == ["Beta is here"]


def test_white_space_is_that_of_regular_expressions(spark):
    rows = ["", " ", "\t\n\x0b\f\r x \t\n\x0b\f\r", "  a  ", "a\n b ", "\x1c a\x85", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", X.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"^\s+|\s+\z", "").alias("r"))
    assert all(r.s == r.r for r in got.collect())
    assert "regexp" not in got.drop("r")._jdf.queryExecution().optimizedPlan().toString()


def test_every_digit():
    assert all(bool(extract.DIGIT.search(chr(i))) == chr(i).isdigit() for i in range(sys.maxunicode + 1))


def test_windows_against_a_loop(spark):
    long = " ".join(f"wörd{i}。" if i % 9 == 0 else f"wort{i}\n" if i % 5 == 0 else f"x{i}" for i in range(1500))
    texts = ["", "  ", " a ", "b" * 1792, "c" * 1793, "d " * 896 + "e", long, "\n" * 1800, "𝔘" * 4000, None]
    want = set()
    for i, t in enumerate(texts):
        for s in [] if t is None else [0] if len(t) <= 1792 else range(0, len(t), 1568):
            end, seg = s + 1792, (t or "")[s + 1692 : s + 1792]
            if len(t) <= 1792 or end >= len(t):
                end = len(t)
            else:
                end = next((end - 100 + seg.rindex(b) + 1 for b in chunk.BOUNDARIES if b in seg), end)
            cut = t if len(t) <= 1792 else re.sub(r"^[ \t-\r]+|[ \t-\r]+\Z", "", t[s:end])
            if cut.strip(" \t\n\x0b\f\r"):
                want.add((i, s, end, cut))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.start, r.end, r.content) for r in chunk.windows(docs).collect()}
    assert got == want and len(want) > 15
    assert chunk.windows(docs).columns == ["doc_id", "text", "start", "end", "content"]
