"""The whole job of corpus operators where a cut would go unseen on the smallest tables."""

import numpy as np
import pytest

from tabveil.llm import jaccard, quality, queries, secrets
from tests.llm import brute


def test_credentials_outside_the_base_patterns(spark):
    rng = np.random.default_rng(8)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    code = lambda: "".join(rng.choice(letters, 24))
    syllables = ["an", "ber", "con", "de", "er", "ing", "lo", "men", "ra", "tion", "ver", "zu"]
    prose = lambda n, most=5: " ".join("".join(rng.choice(syllables, rng.integers(1, most))) for _ in range(n))
    rows = [(k, f"{prose(60)} token = {code()} {prose(20, 9)} on 10.20.{k % 256}.7 in 2024") for k in range(200)]
    planted = [code() for _ in range(200)]  # a share of the uncovered runs far over a thousandth
    rows += [(1000 + k, f"{prose(40)} {c} {prose(20, 9)}") for k, c in enumerate(planted)]
    texts = dict(rows)
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in found for s in r["spans"] if s["kind"] == "format"}
    assert added == {(1000 + k, c) for k, c in enumerate(planted)}


@pytest.mark.parametrize("most_sent, hot_docs", [(500_000, 10_000), (0, 40), (0, 10_000)])
def test_boilerplate_whatever_the_size_of_the_host(spark, most_sent, hot_docs):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = []
    for k in range(4000):  # 25 documents and 50 are under a hundredth of this host's
        foot = ["  Read MORE here", "All rights reserved"] if k < 25 else ["All rights  reserved"] if k < 50 else ["Few hold this"] if k < 70 else []
        rows.append((k, "\n".join([words(k, 12), "", *foot, words(-k, 3)]), "large"))
    rows += [(5000, "Read more here\n" + words(0, 12), "other"), (5001, None, "large"), (5002, "read more HERE", "large")]
    texts = {k: t for k, t, _ in rows}
    got = quality.rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_sent=most_sent, hot_docs=hot_docs)
    assert got.count() == len(rows)
    for r in got.collect():
        k = r["doc_id"]
        if k < 50:
            assert r["n_boiler_words"] == (6 if k < 25 else 3) and r["text"] == f"{words(k, 12)}\n\n{words(-k, 3)}"
        elif k == 5002:
            assert (r["n_boiler_words"], r["text"], r["kept"]) == (3, "", False)
        else:
            assert r["n_boiler_words"] == 0 and r["text"] == texts[k]


def test_lm_query_counts_every_ngram(spark, sf_dir):
    want = brute.backoff([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()], least=1)
    for r in queries.queries()["op9_lm_scoring"](spark, sf_dir).collect():
        assert (r["n_words"], r["log_score"]) == (want[r["doc_id"]][0], pytest.approx(want[r["doc_id"]][1], abs=1e-6))


@pytest.mark.parametrize("name, n, percent", [("small", 4, 85), ("near", 4, 85), ("near", 2, 50), ("near", 3, 100)])
def test_every_link_within_a_component_counts(spark, sf_dir, name, n, percent):
    if name == "small":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    else:  # near copies of one text, of many sizes and more than a block, with repeats, so that components have links of all kinds
        rng = np.random.default_rng(6)
        base = [f"w{i}" for i in range(90)]
        rows = []
        for k in range(170):
            w = list(base)
            for i in rng.integers(0, len(w), rng.integers(0, 4)):
                w[i] = f"x{rng.integers(0, 50)}"
            rows.append((k, " ".join(w[: 90 - 6 * int(rng.integers(0, 6))])))
        rows += [(500 + k, t) for k, t in rows[:9]] + [(900, None), (901, ""), (902, "alone")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, brute.shingles(t, n)) for i, t in docs.collect()]
    want = {i: sum(i != j and bool(x) and 100 * len(x & y) >= percent * len(x | y) for j, y in sets) for i, x in sets}
    assert {r["doc_id"]: r["n_links"] for r in jaccard.similar(docs, n, percent).collect()} == want
