"""Distinct sampled segmentations by perturbed A-star search over the piece lattice."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweek.llm.bpe import batches
from marketweek.llm.storage import ship

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
SAMPLES, SEED = 2, 7
#: A piece weighs the logarithm of its rank in the vocabulary, a byte that of the last rank.
TEMPERATURE = 1.0
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits by which hashes of beginnings of pieces are looked up.
BEGINNING = 20


@lru_cache(maxsize=1)
def lattice(path: str | None = None) -> "Lattice":
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return Lattice(path)


class Numbered(dict):
    """A number for each key, in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Lattice:
    """All segmentations of words into the pieces of a model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.weight = np.full(size, -np.log(size + 1.0) / TEMPERATURE)
        self.weight[ranked] = -np.log(np.arange(len(ranked)) + 2.0) / TEMPERATURE
        known: dict[int, int] = {}
        for i in plain:
            h = 0
            piece = sp.id_to_piece(i)
            for k, c in enumerate(piece):
                h = ((h + ord(c) + 1) * int(BASE)) & (2**64 - 1)
                h ^= h >> 29
                known.setdefault(h, -1)
                if k == len(piece) - 1:
                    known[h] = i
        # One more that nothing is behind, and where the hashes of each beginning start.
        self.hashes = np.array([*sorted(known), 2**64 - 1], np.uint64)
        beginnings = np.arange(1 << BEGINNING, dtype=np.uint64) << np.uint64(64 - BEGINNING)
        self.bucket = np.searchsorted(self.hashes, beginnings).astype(np.int32)
        self.pieces = np.array([known.get(int(h), -1) for h in self.hashes], np.int32)
        #: Text of each piece; None for bytes that make characters only together.
        texts = [sp.id_to_piece(i).replace(SPACE, " ") for i in range(size)]
        for b, i in enumerate(self.byte_ids.tolist()):
            texts[i] = chr(b) if b < 0x80 else None
        self.text_of = np.array(texts, object)
        self.units = Numbered()
        self.reset()

    def reset(self) -> None:
        self.units.clear()
        self.places = self.edges = 0
        # Longer than what they hold, so that most additions copy nothing else.
        self.first = np.zeros(0, np.int64)  # first place of each unit
        self.edge_from = np.zeros(1, np.int64)  # by place: its first edge
        self.edge_to = np.zeros(0, np.int64)
        self.edge_piece = np.zeros(0, np.int32)  # a piece, or minus a code point minus 1
        self.edge_q = np.zeros(0)  # share of the place's mass
        self.rank = np.zeros(0)  # place plus the shares up to the edge

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values at a place of an array, growing it by half at least."""
        held, end = getattr(self, name), at + len(values)
        if end > len(held):
            grown = np.empty(max(end, len(held) * 3 // 2), held.dtype)
            grown[:at] = held[:at]
            setattr(self, name, grown)
            held = grown
        held[at:end] = values

    def learn(self, units: list[str]) -> None:
        """Add units: match pieces at all places at once, then sum masses from the ends."""
        text = "".join(units)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lengths)
        end_of = np.repeat(ends, lengths)
        here = np.arange(len(points))
        h = np.zeros(len(points), np.uint64)
        # Edges by length, each with rising places, so those of one place go on in order.
        found, counts = [], np.zeros(len(points) + 1, np.int64)
        while len(here):
            k = len(found)
            h = (h + points[here + k] + np.uint64(1)) * BASE
            h ^= h >> np.uint64(29)
            at = self.bucket[h >> np.uint64(64 - BEGINNING)]
            behind = np.flatnonzero(self.hashes[at] < h)
            while len(behind):
                at[behind] += 1
                behind = behind[self.hashes[at[behind]] < h[behind]]
            some = self.hashes[at] == h
            piece = np.where(some, self.pieces[at], -1)
            if k == 0:
                # Characters without a piece of their own are spelled in bytes.
                piece = np.where(piece >= 0, piece, -points.astype(np.int64) - 1)
                found.append((here, piece))
            else:
                whole = piece >= 0
                found.append((here[whole], piece[whole]))
            counts[found[-1][0]] += 1
            some &= here + (k + 1) < end_of[here]
            here, h = here[some], h[some]
        free = np.cumsum(counts) - counts
        a, b, piece = (np.empty(int(counts.sum()), np.int64) for _ in range(3))
        for k, (here, pieces) in enumerate(found):
            to = free[here]
            free[here] += 1
            a[to], b[to], piece[to] = here, here + k + 1, pieces
        n_bytes = 1 + (-piece - 1 >= 0x80) + (-piece - 1 >= 0x800) + (-piece - 1 >= 0x10000)
        weight = np.where(piece >= 0, self.weight[np.maximum(piece, 0)], self.weight[self.byte_ids[0]] * n_bytes)
        # Places, with one more behind each unit for its end.
        shift = np.repeat(np.arange(len(units)), lengths)
        place_a, place_b = a + shift[a], b + shift[a]
        total = len(points) + len(units)
        mass = np.full(total, -np.inf)
        mass[ends + np.arange(len(units))] = 0.0
        back = end_of[a] - a
        # Short numbers are sorted in linear time.
        by = np.argsort(back.astype(np.uint16) if lengths.max() < 1 << 16 else back, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(back[by])) + 1):
            if not len(group):
                continue
            value = weight[group] + mass[place_b[group]]
            start = np.flatnonzero(np.concatenate([[True], np.diff(place_a[group]) != 0]))
            top = np.maximum.reduceat(value, start)
            sums = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(start, len(value))))), start)
            mass[place_a[group][start]] = top + np.log(sums)
        q = np.exp(weight + mass[place_b] - mass[place_a])
        counts = np.bincount(place_a, minlength=total)
        froms = np.cumsum(counts) - counts
        running = np.cumsum(q)
        base = np.where(counts > 0, (running - q)[np.minimum(froms, max(len(q) - 1, 0))], 0.0) if len(q) else np.zeros(total)
        inside = running - base[place_a]
        last = froms[counts > 0] + counts[counts > 0] - 1
        inside[last] = 1.0
        offset = self.places
        self.put("first", len(self.units) - len(units), offset + ends - lengths + np.arange(len(units)))
        self.put("edge_from", offset, np.append(self.edges + froms, self.edges + len(place_a)))
        self.put("edge_to", self.edges, offset + place_b)
        self.put("edge_piece", self.edges, piece)
        self.put("edge_q", self.edges, np.clip(q, 0.0, 1.0))
        self.put("rank", self.edges, offset + place_a + inside)
        self.places, self.edges = offset + total, self.edges + len(place_a)

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text, learning new ones."""
        if len(self.units) > 150_000:
            self.reset()
        known = len(self.units)
        # The model's own form: spaces as marks, one more in front.
        rows = [list(map(self.units.__getitem__, UNIT.findall(SPACE + t.replace(" ", SPACE)))) if t else [] for t in texts]
        if len(self.units) > known:
            self.learn(list(islice(self.units, known, None)))
        return [np.array(row, np.int64) for row in rows]

    def walk(self, places: np.ndarray, counts: np.ndarray, rngs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sample ways from ``places`` to the ends of their units: edges in order, the place
        each leaves from and the number of edges there, and the number of edges of each way.
        Each of ``rngs`` serves the next ``counts`` places."""
        at, who = places, np.arange(len(places))
        owner = np.repeat(np.arange(len(counts)), counts)
        steps, lengths = [], np.zeros(len(places), np.int64)
        while True:
            lo, hi = self.edge_from[at], self.edge_from[at + 1]
            open_ = hi > lo
            at, who, lo, hi = at[open_], who[open_], lo[open_], hi[open_]
            if not len(at):
                break
            shares, done = np.empty(len(at)), 0
            drawn = np.bincount(owner[who], minlength=len(counts))
            for d in np.flatnonzero(drawn).tolist():
                n = int(drawn[d])
                rngs[d].random(out=shares[done : done + n])
                done += n
            want = at + shares
            # Few edges leave a place: step over those before the drawn share.
            e, more = lo.copy(), np.flatnonzero(hi - lo > 1)
            while len(more):
                more = more[self.rank[e[more]] <= want[more]]
                e[more] += 1
                more = more[e[more] + 1 < hi[more]]
            lengths[who] += 1
            steps.append((who, e, at, hi - lo))
            at = self.edge_to[e]
        begin = np.cumsum(lengths) - lengths
        out = [np.empty(int(lengths.sum()), np.int64) for _ in range(3)]
        for k, (who, *columns) in enumerate(steps):
            to = begin[who] + k
            for column, x in zip(out, columns):
                column[to] = x
        return *out, lengths

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges, and how many each has: a piece has one, a character spelled in
        bytes one a byte."""
        ids, lengths = self.edge_piece[edges], np.ones(len(edges), np.int64)
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            spelled = [self.byte_ids[list(chr(-p - 1).encode())] for p in ids[lost].tolist()]
            lengths[lost] = [len(x) for x in spelled]
            ids = np.repeat(ids, lengths)
            ids[ids < 0] = np.concatenate(spelled)
        return ids, lengths

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for."""
        try:
            text = "".join(self.text_of[ids].tolist())
        except TypeError:
            return self.model.decode(ids.tolist())
        return text.removeprefix(" ")


def top_segmentations(grid: Lattice, units: np.ndarray, k: int, rng) -> list[tuple[np.ndarray, float, float, float]]:
    """:func:`all_segmentations` of one text."""
    return all_segmentations(grid, [units], k, [rng])[0]


def all_segmentations(grid: Lattice, texts: list[np.ndarray], k: int, rngs: list) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text the ``k`` segmentations with the largest perturbed log probabilities,
    without repeats: ``(edges, log probability, perturbed value, inclusion score)``.

    The search keeps regions of segmentations with a common beginning; a region's bound is its
    largest perturbed value, drawn from a Gumbel at its log mass, truncated at its parent's.
    The best region gives its argmax, sampled from it in proportion, and splits into the
    regions that leave it at each edge. The first ``k`` are a sample without replacement; the
    best bound left is the threshold behind the inclusion scores (Kool et al. 2019, public).

    Texts have heaps and random numbers of their own; the n-th searches of all texts walk the
    lattice together.
    """
    heaps = [[(-rng.gumbel(), 0, None)] for rng in rngs]
    serial, out = 1, [[] for _ in texts]
    firsts = [grid.first[units] for units in texts]
    for n in range(k):
        live = [d for d, heap in enumerate(heaps) if heap]
        if not live:
            break
        taken_from = [heapq.heappop(heaps[d]) for d in live]
        bounds, regions = np.array([-r[0] for r in taken_from]), [r[2] for r in taken_from]
        ways, heads = [], []
        for d, region in zip(live, regions):
            if region is None:
                ways.append(firsts[d])
                continue
            # Keep the beginning, leave the taken edges, then go on freely.
            _, _, unit, place, _, taken = region
            lo, hi = int(grid.edge_from[place]), int(grid.edge_from[place + 1])
            options = [e for e in range(lo, hi) if e not in taken]
            share = list(accumulate(grid.edge_q[options].tolist()))
            e = options[min(bisect_right(share, rngs[d].random() * share[-1]), len(options) - 1)]
            heads.append((e, place, len(options), 1.0 - grid.edge_q[[*taken, e]].sum()))
            ways.append(np.append(grid.edge_to[e], firsts[d][unit + 1 :]))
        counts = np.array([len(w) for w in ways])
        edges, places, single, lengths = grid.walk(np.concatenate(ways), counts, [rngs[d] for d in live])
        way_of, way_end = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(lengths)
        cut = np.concatenate([[0], way_end])[way_of]
        lead = 1 if n else 0
        if lead:
            # All have a beginning now: the edge that leaves it goes before its ways.
            at = cut[:-1]
            e, place, several, rest = zip(*heads)
            edges, places, single = np.insert(edges, at, e), np.insert(places, at, place), np.insert(single, at, several)
            cut = cut + np.arange(len(cut))
        q = grid.edge_q[edges]
        left = 1.0 - q
        if lead:
            left[cut[:-1]] = rest
        # Sums from each text's first edge on, beginning with those before the region.
        sums = np.insert(np.log(np.maximum(q, 1e-300)), cut[:-1], [0.0 if r is None else r[4] for r in regions])
        upto = cut + np.arange(len(cut))
        for a, b in zip(upto.tolist(), upto[1:].tolist()):
            np.cumsum(sums[a:b], out=sums[a:b])
        total, before = sums[upto[1:] - 1], np.delete(sums, upto[1:] - 1)
        # Regions that follow a segmentation up to an edge and leave it there.
        can = np.flatnonzero((single > 1) & (left > 1e-15))
        mass = before[can] + np.log(left[can])
        upto, waits = np.searchsorted(can, cut), np.empty(len(can))
        for d, a, b in zip(live, upto.tolist(), upto[1:].tolist()):
            if a < b:
                rngs[d].standard_exponential(out=waits[a:b])
        g = mass - np.log(np.exp(np.minimum(mass - np.repeat(bounds, np.diff(upto)), 700)) + waits)
        for c, (d, region) in enumerate(zip(live, regions)):
            a, b = int(upto[c]), int(upto[c + 1])
            tail = edges[cut[c] : cut[c + 1]]
            parent, free, unit, _, _, taken = region or (tail[:0], 0, 0, 0, 0.0, ())
            row = np.concatenate([parent[:free], tail])
            out[d].append((row, float(total[c]), float(bounds[c])))
            # One more than is still wanted: the threshold comes from the rest.
            for best in can_best(g[a:b], k - n).tolist() if a < b else ():
                x = int(can[a + best])
                at = x - int(cut[c])
                if lead and at == 0:
                    of, gone = unit, (*taken, int(tail[0]))
                else:
                    of = unit + int(np.searchsorted(way_end, x - lead * (c + 1), "right") - way_of[c])
                    gone = (int(tail[at]),)
                heapq.heappush(heaps[d], (-float(g[a + best]), serial, (row, free + at, of, int(places[x]), float(before[x]), gone)))
                serial += 1
    done = []
    for heap, rows in zip(heaps, out):
        threshold = -heap[0][0] if heap else -np.inf
        done.append([
            (e, p, g, float(-np.expm1(-np.exp(min(p - threshold, 700.0)))) if np.isfinite(threshold) else 1.0)
            for e, p, g in rows
        ])
    return done


def can_best(g: np.ndarray, n: int) -> np.ndarray:
    return np.arange(len(g)) if len(g) <= n else np.argpartition(-g, n - 1)[:n]


def segmentations(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED, text: str = "text") -> DataFrame:
    """Up to ``samples`` distinct segmentations of every text, one row each.

    ``(doc_id, sample, ids, log_prob, perturbed, inclusion, decoded)``: sample 0 has the
    largest perturbed value; ``inclusion`` is the probability of being in the sample given the
    threshold; ``decoded`` is the text that the ids stand for. Randomness is seeded by ``seed``
    and the row's doc_id, so a row gives the same samples in any order and after any loss.

    A text with fewer segmentations has fewer rows; a null or empty text has one row without
    ids; a null doc_id counts as key -1; repeated rows give repeated samples; an empty table
    gives no rows; other columns are ignored.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )

    def run(frames):
        grid = lattice()
        for doc_ids, texts in batches(frames, ["doc_id", "text"], "text", 1_000_000):
            rngs = [np.random.Generator(np.random.Philox(key=[seed, (-1 if d is None else d) % 2**64])) for d in doc_ids]
            found = all_segmentations(grid, grid.codes(texts), samples, rngs)
            rows = [(d, n, *x) for d, several in zip(doc_ids, found) for n, x in enumerate(several)]
            keys, ns, ways, ps, gs, scores = zip(*rows)
            ids, lengths = grid.ids(np.concatenate(ways))
            cut = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, ways)])]
            decoded = [grid.decode(ids[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ns, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32())),
                 *(pa.array(c, pa.float64()) for c in (ps, gs, scores)), pa.array(decoded, pa.string())],
                names=["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion", "decoded"],
            )

    return rows.mapInArrow(
        run,
        "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, decoded string",
    )
