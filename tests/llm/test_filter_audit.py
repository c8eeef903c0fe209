"""The filter audit against applying the filters row by row in every order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from foretime.llm import filter_audit

DOCS = "doc_id long, text string, source string, size long, id long, part string, digest string, w string, good int"


def odd_docs(spark):
    few, many = "word " * 30, " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "  ", few, few, many, many, many + " $", many.upper(), "SHOUT " * 70, "é " * 55, "a\tb\nc d " * 40, many + " |", " ".join(f"x{i}" for i in range(30000)), few]
    rows = [(i, t, [None, "", "s1", "S1"][i % 4], 1, 1, "p", "q", "r", 0) for i, t in enumerate(texts)]
    # repeated rows, one text under several ids, a null id that has copies
    return spark.createDataFrame([*rows, rows[5], rows[14], (None, few, "s1", 0, 0, None, None, None, 1), (-3, many, None, 0, 0, None, None, None, 1)], DOCS)


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 1, 0), (3, 0, 1), (5, None, 1), (8, 1, None), (9, 0, 0), (None, 1, 1), (777, 1, 1)], "doc_id long, quality int, toxic int")


def brute(docs, labels):
    first = {}
    for d in docs:
        if d.doc_id is not None:
            first[d.text or ""] = min(first.get(d.text or "", d.doc_id), d.doc_id)
    rows = {}
    for d in docs:
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d.doc_id is not None and first[t] < d.doc_id}
        good, toxic = (any(x.doc_id == d.doc_id is not None and x[k] == 1 for x in labels) for k in ("quality", "toxic"))
        rows.setdefault(d.source or "", []).append(({f for f in fails if fails[f]}, good, toxic))
    out, shapley = {}, Counter()
    for part, members in rows.items():
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in m[0] for m in members) - len(gone),
                                          sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)]
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.mark.parametrize("parts", [1, 5])
def test_every_order_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(filter_audit, "OPEN_PARTS", 1)
    docs = odd_docs(spark)
    got = filter_audit.audit(docs.repartition(parts), labels(spark))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    assert len(rows) == 3 * 600
    assert Counter(map(tuple, rows)) == brute(docs.collect(), labels(spark).collect())


def test_empty_tables(spark):
    assert filter_audit.audit(odd_docs(spark).limit(0), labels(spark)).count() == 0
    rows = filter_audit.audit(odd_docs(spark), labels(spark).limit(0)).collect()
    assert len(rows) == 1800 and not any(r.good_lost or r.toxic_lost for r in rows)


def test_fields_never_carry():
    steps = filter_audit.PackedSteps("ABCDE")
    assert steps.fields == 601 and len(steps.of_mask) == 32
    times = np.array([(1 << 57) + 3 * m for m in range(32)], object)
    total = sum(int(t) * steps.of_mask[m] for m, t in enumerate(times))
    removed, size = steps.unpack(steps.to_bytes(total))
    assert size == sum(times) < 1 << 63
    for i, order in enumerate(steps.orders):
        for step, f in enumerate(order):
            before = sum(1 << x for x in order[:step])
            assert removed[i, step] == sum(int(t) for m, t in enumerate(times) if m >> f & 1 and not m & before)
    with pytest.raises(OverflowError):
        steps.unpack(steps.to_bytes(steps.of_mask[0] << 63))


def test_other_filters_and_names(spark):
    rows = spark.createDataFrame([("a", True, None), ("a", True, True), (None, False, False)], "part string, x boolean, `y z` boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley, r.marked)
           for r in filter_audit.interactions(rows, ["x", "y z"], "part").collect()}
    assert got["a", "xy z", 2] == (0, 0, 1, 0, 1, []) and got["a", "y zx", 1] == (1, 1, 0, 0, 1, [])
    assert got["", "xy z", 1] == (1, 0, 0, 0, 0, []) and len(got) == 8
    with pytest.raises(ValueError):
        filter_audit.interactions(rows, [], "part")
