import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tagsieve.llm import term_counts as tc


def brute(rows):
    n, records = Counter(), defaultdict(set)
    for record, term in rows:
        if term is not None:
            n[term] += 1
            records[term].add(record)
    return {t: (n[t], len(records[t])) for t in n}


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["the", "the", "the", "a", "", None, *map(str, range(60))])) for _ in range(3_000)]
    df = spark.createDataFrame([(r, t, "x", 1) for r, t in rows], "record long, w string, term string, occurrences int").repartition(7)
    for limit in (tc.MAX_TERMS, 5):
        got = tc.term_counts(df, {"w": F.col("w"), "up": F.upper("w")}, "record", limit).collect()
        assert {r.term: (r.occurrences, r.records) for r in got if r.field == "w"} == brute(rows)
        assert len([r for r in got if r.field == "up"]) == len(brute(rows))


def test_drained_counters_stay_exact():
    rng = np.random.default_rng(2)
    records = np.sort(rng.integers(0, 30, 2_000))
    terms = rng.integers(0, 15, 2_000)
    counters, totals = tc.LastSeen(), defaultdict(lambda: np.zeros(2, int))
    for r, t in zip(np.array_split(records, 90), np.array_split(terms, 90)):
        distinct, codes = np.unique(t, return_inverse=True)
        counters.add([(0, str(x)) for x in distinct], codes, r)
        for (_, term), n, k in zip(*counters.drain(int(r[-1]))):
            totals[term] += (n, k)
    expected = brute([(r, str(t)) for r, t in zip(records.tolist(), terms.tolist())])
    assert {k: tuple(v.tolist()) for k, v in totals.items()} == expected


def test_marks(spark):
    rows = [(s, "all") for s in range(10)] + [(0, "one"), (0, "one")] + [(s, "some") for s in range(4)] + [(s, "half") for s in range(5)]
    df = spark.createDataFrame(rows, "sent_id long, token string")
    marked = tc.mark_terms(tc.term_counts(df, {"token": F.col("token")}, "sent_id"), df, "sent_id")
    assert {r.term: r.mark for r in marked.collect()} == {"all": "common", "one": "rare", "some": "useful", "half": "useful"}


def test_empty_table_and_long_terms(spark):
    df = spark.createDataFrame([], "sent_id long, token string")
    counts = tc.term_counts(df, {"token": F.col("token")}, "sent_id")
    assert counts.count() == 0 and tc.mark_terms(counts, df, "sent_id").count() == 0
    df = spark.createDataFrame([(1, "z" * 300_000), (2, None)], "sent_id long, token string")
    assert [(r.occurrences, r.records) for r in tc.term_counts(df, {"token": F.col("token")}, "sent_id").collect()] == [(1, 1)]
