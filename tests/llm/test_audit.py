"""The filter audit against a loop over documents, orders and steps."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from folioflow.llm import audit, queries

from ..duck import assert_same

SF = "/root/testdata/sf0.001"


def loop(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = defaultdict(Counter)
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                key = (source or "", "".join(order), step)
                out[key]["unique_fails"] += fails[x] and sum(fails.values()) == 1
                if gone:
                    out[key]["redundant"] += fails[x]
                elif fails[x]:
                    gone = True
                    out[key]["removed"] += 1
                    out[key]["good_lost"] += i in good
                    out[key]["toxic_lost"] += i in toxic
                out[key]["kept"] += not gone
    for part in {k[0] for k in out}:
        share = Counter()
        for (p, order, step), c in out.items():
            if p == part:
                share[order[step - 1]] += c["removed"]
        for (p, order, step), c in out.items():
            if p == part:
                c["shapley"] = share[order[step - 1]]
    return {k: tuple(int(c[x]) for x in audit.COUNTS) for k, c in out.items()}


def test_audit_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS_HELD", 2)
    rng = random.Random(11)
    docs = [(1, None, None), (2, "", "a"), (None, "", "a"), (3, "AB 50%", ""), (3, "AB 50%", "b"), (0, "AB 50%", "c"), (None, "x", None)]
    for i in range(60):
        n = rng.choice([3, 199, 200, 400])
        text = " ".join(rng.choice(["w", "Word", f"u{k}", f"v{k}"]) for k in range(n)) + rng.choice(["", " #", " |"])
        docs.append((rng.randint(4, 40), text if rng.random() < 0.7 else docs[rng.randrange(len(docs))][1], rng.choice(["a", "b", "c", None])))
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(30)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1), (7, None, None)]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, source string, part int, label int, failures int")
    got = audit.audit(audit.judged_documents(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in got.collect()} == loop(docs, labels)


def test_other_filters_and_no_rows(spark):
    judged = spark.createDataFrame([("p", 0b10, 3), ("p", 0b11, 0), ("q", 0, 1)], "part string, failures int, label int")
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit(judged, "xy").collect()}
    assert len(got) == 8
    assert (got["p", "xy", 1].removed, got["p", "xy", 2].removed, got["p", "xy", 2].redundant, got["p", "yx", 1].kept) == (1, 1, 1, 0)
    assert (got["p", "yx", 1].good_lost, got["p", "yx", 1].toxic_lost, got["p", "yx", 2].redundant, got["q", "yx", 2].kept) == (1, 1, 1, 1)
    empty = audit.judged_documents(
        spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    )
    assert audit.audit(empty).count() == 0


def test_table():
    table = audit.first_failures()
    assert table.shape == (32, 120)
    assert not table[0].any() and (table[31] == 1).all()


@pytest.mark.parametrize("name", ["op11_filter_audit"])
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
