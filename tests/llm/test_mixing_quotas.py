"""Whole quotas of the mix by brute force, with many small sources."""

import hashlib
import math
import random
import re
from collections import Counter

from wavecrate.llm import mixing


def brute_taken(docs):
    """Of (doc_id, text, source) rows: doc_id, size and words taken, if each source plays its quota."""
    sized = [(d, len(re.findall(mixing.WORD, t)), s) for d, t, s in docs]
    totals = Counter()
    for _, n, s in sized:
        totals[s] += n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(totals.values())
    while free:
        level = left / sum(weight[x] for x in free)
        over = {s for s in free if level * weight[s] > 2 * totals[s]}
        target |= {s: 2 * totals[s] if over else level * weight[s] for s in over or free}
        left -= sum(2 * totals[s] for s in over)
        free = free - over if over else set()
    out = []
    for s in order:
        quota, blocks, stop = math.ceil(target[s] / mixing.BLOCK_WORDS), math.ceil(totals[s] / mixing.BLOCK_WORDS), 0
        times = Counter(rank % blocks for rank in range(quota))
        for _, d, n in sorted((hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest(), d, n) for d, n, x in sized if x == s):
            out.append((d, n, sum(times[word // mixing.BLOCK_WORDS] for word in range(stop, stop + n))))
            stop += n
    return out


def test_small_sources_play_their_quotas(spark):
    rng = random.Random(6)
    docs = [(k, "w " * 200, "big") for k in range(100)] + [(1000 + k, "w " * rng.randint(30, 60), f"s{k:03d}") for k in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = [(r.doc_id, r.size, r.taken) for r in mixing.mix(frame).collect()]
    assert Counter(got) == Counter(brute_taken(docs))
    assert {r.doc_id for r in mixing.mixed_documents(frame).select("doc_id").collect()} >= {d for d, *_ in docs if d >= 1000}


def test_first_and_last_slots_by_playing(spark):
    """Plays all points one by one: which block each plays, and so where a document's words first and last come."""
    rng = random.Random(9)
    docs = [(k, "w " * rng.randint(0, 300), rng.choice(["a", "b", "b", "b", None])) for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mix(frame).collect()}
    sizes = Counter()
    for d, t, s in docs:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    quota = {s: math.ceil(rows[next(d for d, _, x in docs if x == s)].target / mixing.BLOCK_WORDS) for s in order}
    blocks, slots = {s: math.ceil(sizes[s] / mixing.BLOCK_WORDS) for s in order}, sum(quota.values())
    edges, upto = {}, 0
    for s in order:
        edges[s] = (upto << mixing.BITS) // slots, ((upto + quota[s]) << mixing.BITS) // slots
        upto += quota[s]
    played, rank = {}, Counter()
    for i in range(2 * slots):
        u = i * mixing.GOLDEN % (1 << mixing.BITS)
        s = next(s for s in order if edges[s][0] <= u < edges[s][1])
        if rank[s] < quota[s]:
            played.setdefault((s, rank[s] % blocks[s]), []).append(i)
        rank[s] += 1
    for s in order:
        stop = 0
        for _, d, n in sorted((hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest(), d, len(t.split())) for d, t, x in docs if x == s):
            at = [i for b in range(stop // mixing.BLOCK_WORDS, (stop + n - 1) // mixing.BLOCK_WORDS + 1) for i in played.get((s, b), [])] if n else []
            assert (rows[d].first_slot, rows[d].last_slot) == ((min(at), max(at)) if at else (None, None))
            stop += n
