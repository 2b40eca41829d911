"""Packing: exact round trips, the clock and the rounds against plain loops, proportions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs, empty

from tropelens.llm import packing

public = pytest.importorskip("public_tokenizers")
PATHS = {"ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}
FILE = public.path("byte_bpe_50k.json")


def check_whole(pieces, rows, window=1024):
    """Every document's ids are there once, sequences have no gaps and no padding."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(FILE)
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = tuple(np.frombuffer(p["ids"], dtype="<u4").tolist())
        assert len(ids) == p["length"] > 0
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    assert sum(sum(n for _, n in parts) < window for parts in by_sequence.values()) <= window.bit_length()
    for (i, n), parts in by_doc.items():
        copies = [ids for (j, ids), k in want.items() if j == i and len(ids) == n for _ in range(k)]
        have, need = Counter(), Counter()
        for start, ids in parts:
            have.update((start + k, x) for k, x in enumerate(ids))
        for ids in copies:
            need.update(enumerate(ids))
        assert have == need
    assert sum(p["length"] for p in pieces) == sum(len(ids) * k for (_, ids), k in want.items())


def test_every_id_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    table, rows = docs(spark)
    more = [(70, "a <|endoftext|> b", "en", "s0"), (71, "x" + " " * 5000 + "y", "en", "s1"), (72, "\u0085 ​　é\U0001f600  \r\n", "en", "s1"), (73, "a" * 9000, "en", "s0")]
    table = table.union(spark.createDataFrame([(*r, 0, 1.0, None, 1, 1, "") for r in more], table.schema))
    for options in ({"window": 256, "packet": 32}, {"window": 64, "packet": 64, "weights": {"s0": 5, None: 1}, "most_queues": 3}, {"ranks": None}):
        got = packing.pack(table, FILE, **(PATHS | options))
        assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        pieces = got.collect()
        check_whole(pieces, [(r[0], r[1]) for r in rows + more], options.get("window", 1024))
    whole = packing.sequences(got).collect()
    assert sum(r["length"] for r in whole) == sum(p["length"] for p in pieces) and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    one = next(r for r in whole if r["sequence_id"] == 0)
    assert one["ids"] == b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["offset"]) if p["sequence_id"] == 0)
    assert packing.pack(empty(spark), FILE, **PATHS).count() == 0


def test_the_query(spark, tmp_path):
    table, rows = docs(spark)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = packing.pack(spark.read.parquet(str(tmp_path / "documents.parquet")), FILE, **PATHS).collect()
    want = Counter((p["doc_id"], p["start"], p["length"], zlib.crc32(p["ids"]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in pieces)
    assert Counter(map(tuple, packing.query(spark, str(tmp_path)).collect())) == want
    check_whole(pieces, [r[:2] for r in rows])


def test_sequences_hold_the_target_proportions(spark):
    rng = random.Random(2)
    sizes = {"a": 600, "b": 150, "c": 40, None: 10}
    rows = [(k, " ".join(str(rng.randint(0, 999)) for _ in range(rng.randint(1, 200))), s) for s, n in sizes.items() for k in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    source = table.select("doc_id", "source", "text")

    def shares(weights):
        got = packing.pack(table, FILE, weights=weights, packet=64, **PATHS)
        # (id, start) doesn't name a source: ids repeat over sources, so the pieces are matched by their ids' text
        tagged = packing.pack(source.withColumn("doc_id", packing.F.concat_ws("|", packing.F.coalesce("source", packing.F.lit("-")), "doc_id")), FILE, weights=weights, packet=64, **PATHS)
        assert got.count() == tagged.count()
        out = defaultdict(Counter)
        for p in tagged.collect():
            out[p["sequence_id"]][p["doc_id"].split("|")[0]] += p["length"]
        return [out[k] for k in sorted(out)]

    natural = shares(None)
    total = sum(natural, Counter())
    n = sum(total.values())
    for held in natural[: n // 1024]:
        assert all(abs(held[s] - 1024 * total[s] / n) <= 2 * 64 for s in total)
    even = shares({"a": 1, "b": 1, "c": 1, None: 1})
    first = even[0]
    assert all(abs(first[s] - 256) <= 2 * 64 for s in total)  # while all have tokens
    assert set(even[n // 1024 - 1]) == {"a"}  # what is left of the largest


@pytest.mark.parametrize("seed", range(6))
def test_clock(seed):
    rng = np.random.default_rng(seed)
    q = int(rng.integers(1, 9))
    lengths = rng.integers(1, (10, 1000, 10**6, 10**12)[seed % 4], q)
    weights = lengths.astype(float) if seed % 2 else rng.uniform(0.01, 5, q)
    clock = packing.Clock(weights, lengths)
    t = np.unique(np.concatenate([rng.integers(0, clock.total + 1, 50), [0, clock.total, clock.total + 5]]))
    places = clock.places(t)
    assert (places.sum(1) == np.minimum(t, clock.total)).all() and (np.diff(places, axis=0) >= 0).all() and (places <= lengths).all()
    if seed % 2:  # natural shares: within a token a queue
        assert (np.abs(places - lengths / clock.total * np.minimum(t, clock.total)[:, None]) <= q + 1).all()


@pytest.mark.parametrize("unit", [1, 8])
def test_stretches_fall_where_every_single_token_does(unit):
    rng = np.random.default_rng(1)
    tokens, block = np.array([700, 31, 1, 260, 7]), 64 // unit
    lengths = tokens // unit
    for weights in (tokens, np.array([1.0, 4.0, 2.0, 9.0, 1e-4])):
        clock = packing.Clock(weights.astype(float), tokens, unit)
        full = int(lengths.sum()) // block
        borders = clock.places(np.arange(full + 1) * block)
        queue, first, count = [], [], []
        for q, n in enumerate(tokens):
            cuts = np.unique(np.concatenate([[0, n], rng.integers(0, n, 9)]))
            queue += [q] * (len(cuts) - 1)
            first += cuts[:-1].tolist()
            count += np.diff(cuts).tolist()
        order = rng.permutation(len(queue))
        queue, first, count = (np.array(x)[order] for x in (queue, first, count))
        got = set()
        for r, s, n, b in zip(*clock.cut(queue, first, count, block), strict=True):
            for k in range(n):
                got.add((queue[r], first[r] + s + k, b))
        want = set()
        for q, n in enumerate(tokens):
            for x in range(n):
                b = int(np.searchsorted(borders[:, q], x // unit, "right") - 1) if x // unit < lengths[q] else full
                want.add((q, x, b))
        assert got == want


def test_a_rare_source_goes_in_whole_packets():
    tokens = np.array([128 * 10**9, 128 * 50])
    clock = packing.Clock(tokens.astype(float), tokens, 128)
    row, start, length, of = clock.cut(np.array([1]), np.array([0]), np.array([50 * 128]), 2048)
    assert len(row) == 50 and set(length) == {128} and len(set(of)) == 50 and np.ptp(of) > 400_000


@pytest.mark.parametrize("seed", range(4))
def test_rounds_against_a_plain_deficit_round_robin(seed):
    from fractions import Fraction

    rng = np.random.default_rng(seed)
    window, packet = 64, 16
    rows = [(q, int(rng.integers(1, 60))) for q in range(4) for _ in range(int(rng.integers(1, 12)))]
    queue, count = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    place = np.concatenate([np.cumsum(count[queue == q]) - count[queue == q] for q in range(4)])
    total = int(count.sum())
    waiting = {q: [(i, s, min(packet, count[i] - s)) for i in np.flatnonzero(queue == q) for s in range(0, count[i], packet)] for q in range(4)}
    deficit, stream = dict.fromkeys(waiting, Fraction(0)), []
    held = {q: int(count[queue == q].sum()) for q in waiting}
    while any(waiting.values()):
        for q in waiting:
            deficit[q] += Fraction(held[q] * window, total)
            while waiting[q] and waiting[q][0][2] <= deficit[q]:
                i, s, n = waiting[q].pop(0)
                deficit[q] -= n
                stream += [(i, s + k) for k in range(n)]
    got = []
    clock = packing.Clock(np.array([*held.values()], dtype=float), np.array([*held.values()]), packet)
    row, start, length, sequence, offset = packing.laid_out(clock, queue, place, count, window, packet)
    for i in np.lexsort((offset, sequence)):
        got += [(row[i], start[i] + k) for k in range(length[i])]
    assert got == stream
    begins = packing.bounds(total, window)
    assert (begins[sequence] + offset == np.cumsum(length) - length).all()


def test_both_libraries_agree_on_every_character():
    fast, whole = packing.Encoder(FILE, PATHS["ranks"], PATHS["pattern"]), packing.Encoder(FILE, None, None)
    points = [c for c in range(0x3400) if not 0xD800 <= c < 0xE000] + list(range(0xA000, 0x1FFFF, 7)) + [0xE0001, 0x10FFFF]
    for c in points:
        if 0xD800 <= c < 0xE000:
            continue
        text = f"x{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}  {chr(c)}{chr(c)}x\n"
        assert fast.ids(text).tolist() == whole.ids(text).tolist(), hex(c)
