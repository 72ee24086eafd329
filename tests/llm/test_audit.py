"""The filter audit against documents taken through every order one by one."""

import random
import re
from itertools import permutations

from paperloom.llm import filteraudit


def fails(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    found = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
    return {f for f, yes in found.items() if yes}


def brute(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    docs = [(s or "", i, fails(t) | ({"E"} if i is not None and i > least[t or ""] else set())) for i, t, s in rows]
    out = {}
    for part in {p for p, *_ in docs}:
        own = [(i, f) for p, i, f in docs if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in own)
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_audit_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(13)
    texts = [None, "", " \t\n", "A" * 30, "word " * 80, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(60)) + " | ", "é" * 500, "# " * 4000, "\x1c\x85 x\x0by\xa0z", "same same", "Same same"]
    texts += [" ".join(rng.choice(["Up", "low", "a", "b", f"x{rng.random()}"]) for _ in range(rng.randrange(90))) + rng.choice(["", "$"]) for _ in range(40)]
    rows = [(k, rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for k in range(150)]
    rows += [rows[3], rows[3], (None, texts[4], "s1"), (None, None, None), (7, texts[5], "s2")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, least int")
    got = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step], r


def test_audit_of_an_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(docs, labels).count() == 0
