"""The order that the schedule gives to drawn documents."""

import random

from bitloom.llm import mixing


def test_drawn_documents_follow_the_schedule(spark):
    rng = random.Random(3)
    sources = {"a": 300, "b": 500, "c": 200}
    rows = [(f"{s}{i}", s, " ".join(f"{s}{i}w{k}" for k in range(rng.randrange(5, 60)))) for s, n in sources.items() for i in range(n)]
    rows += [("empty", "a", ""), ("null", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string").repartition(5)
    plan = mixing.mix(docs, [3, 1, 2], block=32).collect()
    n = plan[0].n_slots
    taken = [r for r in plan if r.taken]
    assert all(r.slots is None for r in plan if not r.taken) and all(r.n_slots == n for r in plan)
    for r in taken:
        copies = r.passes + (r.part > 0)
        assert copies <= len(r.slots) and r.slots == sorted(r.slots) and 0 <= r.slots[0] and r.slots[-1] <= n
    drawn = mixing.drawn_documents(docs, mixing.mix(docs, [3, 1, 2], block=32)).collect()
    first = {r.doc_id: r.slots for r in taken}
    met, slots = {}, []
    for r in drawn:
        slots.append(first[r.doc_id][met.setdefault(r.doc_id, 0)])
        met[r.doc_id] += 1
    assert slots == sorted(slots) and sum(met.values()) == len(drawn)
    words = [(r.source, len(r.text.split())) for r in drawn]
    total = sum(w for _, w in words)
    share = {s: sum(w for t, w in words if t == s) / total for s in sources}
    at, seen, checked = 0, dict.fromkeys(sources, 0), 0
    for s, w in words:
        seen[s] += w
        at += w
        if 0.1 < at / total < 0.9:  # every prefix holds the sources in their shares
            checked += 1
            assert all(abs(seen[t] / at - share[t]) < 0.06 for t in sources)
    assert checked > 100
