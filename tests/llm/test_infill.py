"""Texts cut for filling in the middle, against lists of all tokens."""

import hashlib
import re
import time
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import infill

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def plain(doc_id, text, cut=50, suffix_first=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(UNIT, text)
    assert "".join(units) == text
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= cut:
        return len(units), "plain", None, None, text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["a<P>b", "<S>", "x<M>", "a<S b", "<", "< S >", "<P", "P> <S", "<S<S<", "\t\n\v\f\r", " a", "a ", "😀 é\x00b\x85c", "<p> <s> <m>", "M>", "S>", "a b\xa0c"]


@pytest.mark.parametrize("most", [10, 8 << 20])
def test_outputs_and_round_trip(spark, docs, corpus, most):
    odd = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD * 20)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    made = infill.transform(both, most=most).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    got = Counter(tuple(r) for r in made.select("doc_id", "text", *infill.MADE, "restored").collect())
    texts = [(c[0], c[1]) for c in corpus] + [(1000 + k, t) for k, t in enumerate(ODD * 20)]
    assert got == Counter((k, t or "", *plain(k, t), t or "") for k, t in texts)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_all_texts_cut_either_way(spark, docs, corpus):
    for first in (0, 100):
        made = infill.transform(docs, cut=100, suffix_first=first).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
        got = Counter(tuple(r) for r in made.select("doc_id", "form", "output", "restored").collect())
        want = Counter((c[0], x[1], x[4], c[1] or "") for c in corpus for x in [plain(c[0], c[1], 100, first)])
        assert got == want and "plain" in {r[1] for r in got}  # the empty ones


def test_columns_of_clashing_names_and_empty_tables(spark, no_docs):
    made = infill.transform(spark.createDataFrame([(1, "a b", 7, "x", 3, 4)], "doc_id long, text string, N long, Form string, _h1 int, other int"))
    assert made.columns == ["doc_id", "other", "text", *infill.MADE] and made.first().other == 4
    assert infill.transform(no_docs).count() == 0


def test_no_list_of_tokens_is_held():
    text = "ab " * 1_000_000
    began = time.perf_counter()
    tracemalloc.start()
    n = infill.count_units(text)
    assert infill.unit_ends(text, n // 3, 2 * n // 3) == (n // 3 * 3 - 1, 2 * n // 3 * 3 - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000_001 and peak < 100_000 and time.perf_counter() - began < 30


def test_ranks_at_the_ends():
    assert infill.unit_ends("a b", 0, 0) == (0, 0) and infill.unit_ends("a b", 0, 2) == (0, 3) and infill.unit_ends("a b", 2, 2) == (3, 3) and infill.unit_ends("a b", 1, 2) == (1, 3)
