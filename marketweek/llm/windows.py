"""Near-duplicate passages by compact windows over hashes of shingle runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweek.llm.bpe import batches
from marketweek.llm.components import connected_components
from marketweek.llm.storage import ship, staged

SHINGLE, PASSAGE, SIMILARITY = 5, 50, 0.8
LEAST = PASSAGE - SHINGLE + 1
#: Words by which the places of one passage may shift between two texts.
SLACK = 12
#: Pairs of equal shingles that are in memory at once.
PAIRED = 4_000_000
#: Equal shingles in a row that every passage without repeats in itself has.
SEED = 20
#: Shingles in a row that make a key, and shingles on both sides that are compared in a run.
GRAM, REACH = 10, 46
#: Equal shingles around a key from which on two texts are compared in full. The passage's
#: length next to some key has at most one changed word, so it has more even if it says a few
#: words twice in a row.
CLOSE = 28
#: Equal places of a passage that make up for one that differs: one of nine may.
WEIGHT = round(2 * SIMILARITY / (1 - SIMILARITY))
#: Rows of a run that are all compared with each other.
FEW = 6
#: Nearly equal rows of a run that are looked at before all others.
TOP = 16


class WordHashes(dict):
    """64-bit hash of each word, remembered while a task runs."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of every run of ``SHINGLE`` word hashes."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = mixed(out + words[k : k + n])
    return out


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in characters."""
    raw = np.frombuffer(text.encode(), np.uint8)
    blank = np.concatenate([[True], (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)), [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    # Characters before each byte: those that aren't continuations.
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return chars[edge[::2]], chars[edge[1::2]]


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    low, done = values, 1
    while 2 * done <= width:
        low, done = np.minimum(low[:-done], low[done:]), 2 * done
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - done : width - done + n])


def compact_windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int):
    """Windows ``(l, c, r)``, ends included, of at least ``least`` places whose minimum is at c.

    They are the upper nodes of the Cartesian trees of all ranges: every sub-range of at least
    ``least`` places lies, around its minimum, in exactly one window. Their minima are those of
    the runs of ``least`` places, so the trees are built over these alone: all ranges are split
    at their minima at once, level by level. The leftmost of equal minima counts.
    """
    none = np.zeros(0, np.int64)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, none
    place = np.uint64((1 << max(24, len(values).bit_length())) - 1)
    keys = (values & ~place) | np.arange(len(values), dtype=np.uint64)
    low = sliding_minima(keys, least)
    # Runs inside a range alone; minima of runs in order never step back.
    inside = np.zeros(len(values) + 1, np.int8)
    inside[starts] += 1
    inside[ends - least + 1] -= 1
    some = low[np.cumsum(inside)[: len(low)] > 0]
    some = some[np.concatenate([[True], some[1:] != some[:-1]])]
    at = (some & place).astype(np.int64)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    some = np.append(some, ~np.uint64(0))
    # Ranges of minima, and the places that each of them spans.
    lo, hi, l, r = first, last, starts, ends
    found = []
    while len(lo):
        bounds = np.stack([lo, hi], axis=1).reshape(-1)
        c = (np.minimum.reduceat(some, bounds)[::2] & place).astype(np.int64)
        found.append((l, c, r - 1))
        m = np.searchsorted(at, c)
        lo, hi = np.stack([lo, m + 1], axis=1).reshape(-1), np.stack([m, hi], axis=1).reshape(-1)
        l, r = np.stack([l, c + 1], axis=1).reshape(-1), np.stack([c, r], axis=1).reshape(-1)
        left = hi > lo
        lo, hi, l, r = lo[left], hi[left], l[left], r[left]
    return tuple(np.concatenate(x) for x in zip(*found))


def thinned(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles without those that equal the one before, and the ones that fill a whole passage.

    A passage of one word has one shingle; its copies meet under that, and every other text is
    searched as if a word said over and over stood there once.
    """
    if len(part) < LEAST:
        # Shorter texts have no passage.
        return part[:0], part[:0]
    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return part[new], np.unique(part[new][np.diff(np.append(new, len(part))) >= LEAST])


def anchors(parts: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, text, place)`` of the minima of all compact windows of ``SEED`` shingles.

    A key stands for ``GRAM`` shingles in a row, so every run of ``SEED`` equal shingles in two
    texts has a key in common there, whatever stands around it.
    """
    values = np.concatenate(parts)
    n = max(len(values) - GRAM + 1, 0)
    # Shingles overlap: every SHINGLE-th one and the last hold all words.
    hashed = np.zeros(len(values), np.uint64)
    for k in [*range(0, GRAM - 1, SHINGLE), GRAM - 1]:
        hashed[:n] = mixed(hashed[:n] + values[k : k + n])
    starts = ends - np.array([len(p) for p in parts], np.int64)
    _, c, _ = compact_windows(hashed, starts, np.maximum(starts, ends - GRAM + 1), SEED - GRAM + 1)
    of = np.searchsorted(ends, c, side="right")
    return hashed[c].view(np.int64), of, c


def sorted_runs(frames, names: list[str]):
    """Columns of sorted batches, regrouped so that no run of equal keys is cut."""
    held = None
    for frame in frames:
        now = [frame.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now)]
        if not len(now[0]):
            continue
        at = int(np.searchsorted(now[0], now[0][-1]))
        if at:
            yield [x[:at] for x in now]
        held = [x[at:] for x in now]
    if held is not None and len(held[0]):
        yield held


def shared_keys(docs: DataFrame) -> DataFrame:
    """``(doc, keys)``: the keys of each document that another one also has."""
    import pyarrow as pa

    def run(frames):
        known = WordHashes()
        for doc_ids, texts in batches(frames, ["doc_id", "text"], "text", 3_000_000):
            parts, alone = zip(*[thinned(shingles(word_hashes(t, known))) for t in texts])
            key, of, _ = anchors(parts, np.cumsum([len(p) for p in parts]))
            key = np.concatenate([key, *[mixed(a).view(np.int64) for a in alone]])
            of = np.concatenate([of, np.repeat(np.arange(len(alone)), [len(a) for a in alone])])
            rows = np.unique(np.stack([key, np.asarray(doc_ids, np.int64)[of]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "doc"])

    def shared(frames):
        for key, doc in sorted_runs(frames, ["key", "doc"]):
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(new, len(key)))
            # Sorted by document: a run of one document begins and ends with it.
            keep = np.repeat(doc[new] != doc[new + size - 1], size)
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(key[keep])], names=["doc", "key"])

    rows = docs.mapInArrow(run, "key long, doc long").repartition("key").sortWithinPartitions("key", "doc")
    found = rows.mapInArrow(shared, "doc long, key long")
    return found.groupBy("doc").agg(F.collect_set("key").alias("keys"))


def surroundings(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, doc, thin, around)``: the shingles around each place of a shared key, in 16 bits
    each, 0 outside the text. Equal surroundings of one text count once. ``thin``: places of a
    word said over and over were left out of the text."""
    import pyarrow as pa

    names = ["key", "doc", "thin", "around"]

    def run(frames):
        known = WordHashes()
        for doc_ids, keys, texts in batches(frames, ["doc", "keys", "text"], "text", 3_000_000):
            whole = [shingles(word_hashes(t, known)) for t in texts]
            parts, alone = zip(*[thinned(part) for part in whole])
            thin = [len(p) < len(part) for p, part in zip(parts, whole)]
            ends = np.cumsum([len(p) for p in parts])
            key, of, place = anchors(parts, ends)
            sizes = [len(k) for k in keys]
            wanted = np.stack([np.repeat(np.arange(len(keys)), sizes), np.concatenate(keys).astype(np.int64)])
            # Keys are looked up by text and key at once.
            mine = mixed(key.view(np.uint64) + mixed(of.astype(np.uint64)))
            wanted = np.sort(mixed(wanted[1].view(np.uint64) + mixed(wanted[0].astype(np.uint64))))
            some = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
            key, of, place = key[some], of[some], place[some]
            short = np.maximum(np.concatenate(parts) >> np.uint64(48), np.uint64(1)).astype(np.uint16)
            for lo in range(0, len(key), 20_000):
                s = slice(lo, lo + 20_000)
                at = place[s, None] + np.arange(-REACH, GRAM + REACH)
                starts = (ends - [len(p) for p in parts])[of[s], None]
                inside = (at >= starts) & (at < ends[of[s], None])
                around = np.where(inside, short[np.clip(at, 0, len(short) - 1)], np.uint16(0))
                rows = list(dict.fromkeys(zip(key[s].tolist(), of[s].tolist(), (r.tobytes() for r in around))))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([doc_ids[r[1]] for r in rows], pa.int64()),
                    pa.array([thin[r[1]] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary()),
                ], names=names)
            pairs = [(int(k), d) for a, d in zip(alone, doc_ids) for k in mixed(a).view(np.int64)]
            alike = np.ones(GRAM + 2 * REACH, np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in pairs], pa.int64()), pa.array([d for _, d in pairs], pa.int64()),
                pa.array([True] * len(pairs), pa.bool_()), pa.array([alike] * len(pairs), pa.binary()),
            ], names=names)

    joined = keys.hint("merge").join(docs, F.col("doc") == F.col("doc_id")).select("doc", "keys", "text")
    return joined.mapInArrow(run, "key long, doc long, thin boolean, around binary")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of each row of x whose shingle its row of y has anywhere."""
    out = [((p[:, :, None] == q[:, None, :]).any(axis=2) & (p != 0)).sum(axis=1)
           for p, q in ((x[k : k + 1000], y[k : k + 1000]) for k in range(0, len(x), 1000))]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _links(doc: np.ndarray, around: np.ndarray) -> set[tuple[int, int]]:
    """Pairs ``(doc, earlier doc)`` of one run of a key, its rows sorted by document.

    A row that has a passage's length of shingles in common with an earlier one, without a gap
    around the key, is a copy of it there and goes to its class. Every row is compared with the
    first row of every class, a copy also with the row before it in its class; rows of different
    classes meet where enough shingles around the key are equal. What a class's first row lacks
    is looked for in its other rows.
    """
    first = np.empty(around.shape, around.dtype)
    row = np.zeros(len(doc), np.int64)
    others: list[list[int]] = []
    seen = np.zeros(1 << 16, bool)
    found = set()
    for i, mine in enumerate(around):
        k = len(others)
        seen[mine] = True
        seen[0] = False
        near = np.flatnonzero(np.count_nonzero(seen[first[:k]], axis=1) >= CLOSE)
        same = (first[near] == mine) & (mine != 0)
        right = np.logical_and.accumulate(same[:, REACH:], axis=1).sum(axis=1)
        left = np.logical_and.accumulate(same[:, REACH - 1 :: -1], axis=1).sum(axis=1)
        copies = near[left + right >= LEAST]
        if len(copies):
            own = int(copies[0])
            meets = row[near].tolist() + others[own][-1:]
            others[own].append(i)
        else:
            meets = row[near]
            first[k], row[k] = mine, i
            others.append([])
            far = [r for c in set(range(k)).difference(near.tolist()) for r in others[c]]
            if far:
                hits = np.count_nonzero(seen[around[far]], axis=1) >= CLOSE
                meets = np.concatenate([meets, np.array(far)[hits]])
        found.update((int(doc[i]), int(d)) for d in set(doc[np.asarray(meets, np.int64)].tolist()) if d != doc[i])
        seen[mine] = False
    return found


def _runs_to_key(step: np.ndarray, least) -> np.ndarray:
    """The largest sum of ``step`` over a stretch of ``least`` places or more that holds the key."""
    flat = np.zeros((len(step), 1), np.int32)
    right = np.concatenate([flat, np.cumsum(step[:, REACH + GRAM :], axis=1, dtype=np.int32)], axis=1)
    left = np.concatenate([flat, np.cumsum(step[:, REACH - 1 :: -1], axis=1, dtype=np.int32)], axis=1)
    right = np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1]
    if np.ndim(least):
        rest = np.maximum(least[:, None] - GRAM - np.arange(REACH + 1), 0)
        right = np.take_along_axis(right, rest, axis=1)
    else:
        right = right[:, np.maximum(least - GRAM - np.arange(REACH + 1), 0)]
    return (left + right).max(axis=1) + step[:, REACH : REACH + GRAM].sum(axis=1, dtype=np.int32)


def _one_gap(has: np.ndarray) -> np.ndarray:
    """Whether places miss in one piece alone, too long for a whole passage around it to be
    within reach: what follows must be looked up."""
    missing = has.shape[1] - np.count_nonzero(has, axis=1)
    edges = np.count_nonzero(has[:, 1:] != has[:, :-1], axis=1)
    return (edges == 2) & has[:, 0] & has[:, -1] & (missing > SHINGLE + 1) & (missing <= 2 * SHINGLE)


def _sure(x: np.ndarray, y: np.ndarray, plain: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Whether rows of x and y surely share a passage along the key.

    A changed word takes ``SHINGLE`` places or more; where fewer differ, one may seem equal by
    its 16 bits alone and doesn't count. Nor do the ``again`` places that repeat another one.
    Rows that aren't ``plain`` must be equal over a passage's whole length; that is enough for
    rows whose places repeat, too, such as those of two words said in turn over and over.
    """
    same = (x == y) & (x != 0)
    gain = _runs_to_key(np.where(same, 1, -WEIGHT).astype(np.int8), LEAST) - (WEIGHT + 1) * again
    sure = (gain >= 0) & plain
    rest = np.flatnonzero(sure & (gain <= WEIGHT))
    if len(rest):
        has = same[rest]
        gap = np.ones(len(rest), bool)
        for n in range(1, SHINGLE):
            ends = has[:, : -n - 1] & has[:, n + 1 :]
            for k in range(1, n + 1):
                ends &= ~has[:, k : k - n - 1]
            gap &= ~ends.any(axis=1)
        sure[rest] = gap
    rest = np.flatnonzero(~sure & ((again > 0) | ~plain))
    if len(rest):
        right = np.logical_and.accumulate(same[rest, REACH:], axis=1).sum(axis=1)
        left = np.logical_and.accumulate(same[rest, REACH - 1 :: -1], axis=1).sum(axis=1)
        sure[rest] = left + right >= LEAST
    return sure


def _possible(x: np.ndarray, y: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """Whether rows of x and y may share a passage around the key, at whatever shift.

    A passage of the wanted similarity has ``WEIGHT`` equal places for one that differs, and a
    smallest part of it that has as many holds one gap at most, with a key beside it. ``thin``:
    places of a repeated word were left out, so a passage may be shorter here.
    """
    out = np.zeros(len(x), bool)
    for lo in range(0, len(x), 1000):
        s = slice(lo, lo + 1000)
        equal = (x[s][:, :, None] == y[s][:, None, :]) & (x[s] != 0)[:, :, None]
        one, two = equal.any(axis=2), equal.any(axis=1)
        least = np.where(thin[s], CLOSE, LEAST)
        gain = sum(_runs_to_key(np.where(has, 1, -WEIGHT).astype(np.int8), least) for has in (one, two))
        out[s] = (np.count_nonzero(one, axis=1) >= CLOSE) & (
            (gain >= 0) | _one_gap(one[:, REACH:]) | _one_gap(one[:, : REACH + GRAM]))
    return out


def _firsts(run: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each row the first one of its run with the same surroundings, of a passage's length."""
    digest = mixed(run.astype(np.uint64))
    for column in np.ascontiguousarray(around).view(np.uint16).T:
        digest = (digest ^ column) * np.uint64(0x9E3779B97F4A7C15)
        digest ^= digest >> np.uint64(29)
    order = np.argsort(digest, kind="stable")
    new = np.concatenate([[True], digest[order][1:] != digest[order][:-1]])
    first = np.empty(len(run), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    equal = (run[first] == run) & (around[first] == around).all(axis=1) & (np.count_nonzero(around, axis=1) >= LEAST)
    return np.where(equal, first, np.arange(len(run)))


def _forest(doc: np.ndarray, around: np.ndarray, thin: np.ndarray) -> set[tuple[int, int]]:
    """Pairs ``(doc, earlier doc)`` that connect what all pairs of one run connect.

    A row that surely shares a passage with an earlier one joins its class and meets no other
    row of it: rows of a class are linked through each other, and the row's own passage is found
    with the one it joins. Classes that a row joins both become one. A row that joins none is
    compared with all rows, and meets those of other classes that may share a passage with it.
    """
    found = set()
    m = len(doc)
    some = np.sort(around, axis=1)
    # Shingles that repeat count once in a similarity.
    again = np.count_nonzero((some[:, 1:] == some[:, :-1]) & (some[:, 1:] != 0), axis=1)
    lead, members, own = (np.zeros(m, np.int64) for _ in range(3))
    first = np.empty(around.shape, around.dtype)
    root = np.arange(m)  # by class: the one it has become
    k = n = 0
    seen = np.zeros(1 << 16, bool)

    def surely(i: int, rows: np.ndarray, classes: np.ndarray) -> tuple[list, list]:
        """Of each class that row i surely meets in ``rows``: the class, and the first such row."""
        sure = _sure(around[rows], around[i : i + 1], ~thin[rows] & ~thin[i], np.maximum(again[rows], again[i]))
        links = dict(zip(classes[sure][::-1].tolist(), rows[sure][::-1].tolist()))
        return list(links), list(links.values())

    def search(i: int, rows: np.ndarray, of: np.ndarray, values: np.ndarray) -> tuple[list, list, np.ndarray]:
        """Classes that row i surely meets, a row of each, and rows of others that it may meet."""
        classes = root[of]
        equal = np.count_nonzero(values == around[i], axis=1)
        apart = doc[rows] != doc[i]
        # The first rows before all others: most are of their classes, and the fewer rows are met
        # under all keys of a text, the fewer texts are compared with it.
        top = np.flatnonzero((equal >= CLOSE) & apart)[:TOP]
        met, links = surely(i, rows[top], classes[top]) if len(top) else ([], [])
        for c in met:
            apart &= classes != c
        rest = np.flatnonzero(apart)
        if not len(rest):
            return met, links, rows[rest]
        seen[around[i]] = True
        seen[0] = False
        rest = rest[np.count_nonzero(seen[values[rest]], axis=1) >= CLOSE]
        seen[around[i]] = False
        if len(rest):
            more, rows_met = surely(i, rows[rest], classes[rest])
            met, links = met + more, links + rows_met
            rest = rest[~np.isin(classes[rest], more)] if more else rest
            mine = np.broadcast_to(around[i], (len(rest), around.shape[1]))
            rest = rest[_possible(around[rows[rest]], mine, thin[rows[rest]] | thin[i])]
        return met, links, rows[rest]

    for i in range(m):
        met, links, maybe = search(i, lead[:k], np.arange(k), first[:k]) if k else ([], [], lead[:0])
        joins = len(met) > 0
        if not joins and n:
            # Members of classes, too: one of them may be nearer than its first row.
            met, links, more = search(i, members[:n], own[:n], around[members[:n]])
            maybe = np.concatenate([maybe, more])
        found.update((int(doc[i]), int(doc[r])) for r in [*links, *maybe.tolist()])
        if joins:
            members[n], own[n] = i, met[0]
            n += 1
        else:
            first[k], lead[k] = around[i], i
            met.append(k)
            k += 1
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    return found


def _connecting(key: np.ndarray, doc: np.ndarray, around: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """Pairs ``(doc, earlier doc)`` of whole runs of keys, each run's rows sorted by document,
    that connect what all pairs connect. Rows with equal surroundings meet the first of them."""
    run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    first = _firsts(run, around)
    later = np.flatnonzero(first < np.arange(len(key)))
    pairs = [np.stack([doc[later], doc[first[later]]], axis=1)]
    left = np.flatnonzero(first == np.arange(len(key)))
    new = np.flatnonzero(np.concatenate([[True], run[left][1:] != run[left][:-1]]))
    size = np.diff(np.append(new, len(left)))
    for n in range(2, FEW + 1):
        i, j = (np.concatenate(c) for c in zip(*[(new[size == n] + a, new[size == n] + b) for a in range(n) for b in range(a)]))
        for lo in range(0, len(i), 20_000):
            a, b = left[i[lo : lo + 20_000]], left[j[lo : lo + 20_000]]
            a, b = a[doc[a] != doc[b]], b[doc[a] != doc[b]]
            some = _possible(around[a], around[b], thin[a] | thin[b])
            pairs.append(np.stack([doc[a][some], doc[b][some]], axis=1))
    for lo, n in zip(new[size > FEW], size[size > FEW]):
        r = left[lo : lo + n]
        pairs.append(np.array(sorted(_forest(doc[r], around[r], thin[r])), np.int64).reshape(-1, 2))
    return np.unique(np.concatenate(pairs), axis=0)


def candidates(rows: DataFrame, every: bool = True) -> DataFrame:
    """``(doc, other)``: pairs of documents that may share a passage, from :func:`surroundings`;
    all of them, or those that connect what all connect."""
    import pyarrow as pa


    def run(frames):
        for key, doc, thin, around in sorted_runs(frames, ["key", "doc", "thin", "around"]):
            around = np.frombuffer(b"".join(around), np.uint16).reshape(len(key), GRAM + 2 * REACH)
            if not every:
                pairs = _connecting(key, doc, around, thin.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc", "other"])
                continue
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(new, len(key)))
            two = new[size == 2]
            two = two[doc[two] != doc[two + 1]]
            two = two[_common(around[two], around[two + 1]) >= CLOSE]
            found = set(zip(doc[two + 1].tolist(), doc[two].tolist()))
            for lo, n in zip(new[size > 2], size[size > 2]):
                if doc[lo] != doc[lo + n - 1]:
                    found |= _links(doc[lo : lo + n], around[lo : lo + n])
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc", "other"])

    return rows.repartition("key").sortWithinPartitions("key", "doc", "around").mapInArrow(run, "doc long, other long").distinct()


class Matches:
    """Where each shingle of x stands in y: ``order[left:right]``, rising. Sorts y once."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.order = np.argsort(y, kind="stable")
        ranked = y[self.order]
        self.left, self.right = np.searchsorted(ranked, x, "left"), np.searchsorted(ranked, x, "right")
        # A number for each shingle of y: the place of its first one in the order.
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(y) else np.zeros(0, bool)
        self.y = np.empty(len(y), np.int64)
        self.y[self.order] = np.maximum.accumulate(np.where(new, np.arange(len(y)), 0))
        self.x = np.where(self.right > self.left, self.left, len(y))
        self.y_last = np.full(len(y), -1)
        again = np.flatnonzero(~new)
        self.y_last[self.order[again]] = self.order[again - 1]


def diagonals(at: Matches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal shingles ``(x start, y start, length)``: every place of a shingle
    in x meets every place of it in y. Places are paired in slices of bounded size."""
    order, left, right = at.order, at.left, at.right
    places = np.flatnonzero(right > left)
    counts = (right - left)[places]
    pieces, lo = [], 0
    sums = np.concatenate([[0], np.cumsum(counts)])
    while lo < len(places):
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + PAIRED, "right")) - 1)
        n = counts[lo:hi]
        i = np.repeat(places[lo:hi], n)
        j = order[np.repeat(left[places[lo:hi]] - (sums[lo:hi] - sums[lo]), n) + np.arange(n.sum())]
        by = np.lexsort((i, j - i))
        i, j = i[by], j[by]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
        pieces.append((i[new], j[new], np.diff(np.append(new, len(i)))))
        lo = hi
    if not pieces:
        return (np.zeros(0, np.int64),) * 3
    i, j, n = (np.concatenate(c) for c in zip(*pieces))
    by = np.lexsort((i, j - i))
    i, j, n = i[by], j[by], n[by]
    # Slices cut runs.
    new = np.concatenate([[True], (i[1:] != i[:-1] + n[:-1]) | (j[1:] != j[:-1] + n[:-1])])
    return i[new], j[new], np.add.reduceat(n, np.flatnonzero(new))


class Chains:
    """Chains of the runs ``(i, j, n)`` of :func:`diagonals`.

    Both ways from a run, the run with the least gap and shift is next, while places rise in
    both texts. What follows a run depends on its end alone and what precedes it on its start,
    so each is looked up once, however many chains lead through it.
    """

    def __init__(self, i: np.ndarray, j: np.ndarray, n: np.ndarray):
        self.i, self.j, self.n = i, j, n
        self.after: dict[int, tuple[int, int] | None] = {}
        self.before: dict[int, tuple[int, int] | None] = {}

    def following(self, k: int) -> tuple[int, int] | None:
        """The run after ``k``, and how many of its first shingles are passed already."""
        if k not in self.after:
            a, b = self.i[k] + self.n[k] - 1, self.j[k] + self.n[k] - 1
            cut = np.maximum(0, np.maximum(a + 1 - self.i, b + 1 - self.j))
            p, q = self.i + cut - a, self.j + cut - b
            ok = np.flatnonzero((cut < self.n) & (np.abs(p - q) <= PASSAGE))
            c = ok[np.argmin(np.maximum(p, q)[ok] + np.abs(p - q)[ok])] if len(ok) else -1
            self.after[k] = (int(c), int(cut[c])) if len(ok) else None
        return self.after[k]

    def preceding(self, k: int) -> tuple[int, int] | None:
        """The run before ``k``, and how many of its shingles lie before it."""
        if k not in self.before:
            a, b = self.i[k], self.j[k]
            left = np.minimum(self.n, np.minimum(a - self.i, b - self.j))
            p, q = a - (self.i + left - 1), b - (self.j + left - 1)
            ok = np.flatnonzero((left > 0) & (np.abs(p - q) <= PASSAGE))
            c = ok[np.argmin(np.maximum(p, q)[ok] + np.abs(p - q)[ok])] if len(ok) else -1
            self.before[k] = (int(c), int(left[c])) if len(ok) else None
        return self.before[k]

    def through(self, k: int) -> tuple[tuple[int, int, int], ...]:
        """Parts ``(x start, y start, length)`` of the chain through run ``k``."""
        parts = [(int(self.i[k]), int(self.j[k]), int(self.n[k]))]
        step = self.following(k)
        while step:
            c, cut = step
            parts.append((int(self.i[c]) + cut, int(self.j[c]) + cut, int(self.n[c]) - cut))
            step = self.following(c)
        step = self.preceding(k)
        while step:
            c, left = step
            parts.append((int(self.i[c]), int(self.j[c]), left))
            step = self.preceding(c)
        return tuple(sorted(parts))


class Overlap:
    """Jaccard similarity of the sets of shingles of ranges of two texts, without sorting anew."""

    def __init__(self, x: np.ndarray, at: Matches):
        self.x, self.y, self.y_last = at.x, at.y, at.y_last
        # The place before each one that holds the same shingle, -1 where none does.
        order = np.argsort(x, kind="stable")
        again = np.flatnonzero(x[order][1:] == x[order][:-1]) + 1
        self.x_last = np.full(len(x), -1)
        self.x_last[order[again]] = order[again - 1]
        self.seen = np.zeros(len(at.y) + 1, bool)

    def score(self, a: int, b: int, c: int, d: int) -> float:
        """Similarity of ``x[a:b]`` and ``y[c:d]``."""
        mine = self.x[a:b][self.x_last[a:b] < a]
        others = self.y[c:d][self.y_last[c:d] < c]
        self.seen[others] = True
        both = int(np.count_nonzero(self.seen[mine]))
        self.seen[others] = False
        return both / (len(mine) + len(others) - both)


def similar_parts(overlap: Overlap, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages of one chain; what falls short is split at its widest gap."""
    work, out = [(0, len(i))], []
    while work:
        a, b = work.pop()
        if b - a < SIMILARITY * LEAST:
            continue
        nx, ny = i[b - 1] - i[a] + 1, j[b - 1] - j[a] + 1
        score = overlap.score(i[a], i[b - 1] + 1, j[a], j[b - 1] + 1)
        if score >= SIMILARITY:
            if min(nx, ny) >= LEAST:
                out.append((int(i[a]), int(i[b - 1]) + 1, int(j[a]), int(j[b - 1]) + 1, score))
            continue
        gaps = np.maximum(i[a + 1 : b] - i[a : b - 1], j[a + 1 : b] - j[a : b - 1])
        cut = int(gaps.argmax()) if len(gaps) else 0
        if len(gaps) == 0 or gaps[cut] <= 1:
            continue
        cut += a + 1
        work += [(a, cut), (cut, b)]
    return out


def outermost(spans: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Spans, sorted, without those that lie inside another one in both texts."""
    spans = sorted(set(spans))
    if len(spans) < 2:
        return spans
    a, b, c, d = np.array([s[:4] for s in spans], np.int64).T
    out = []
    for lo in range(0, len(spans), 256):
        s = slice(lo, lo + 256)
        held = (a <= a[s, None]) & (b[s, None] <= b) & (c <= c[s, None]) & (d[s, None] <= d)
        # Each lies in itself; equal places have equal scores, so none is there twice.
        out += [spans[lo + k] for k in np.flatnonzero(held.sum(axis=1) == 1)]
    return out


def nearest_places(at: Matches) -> tuple[np.ndarray, np.ndarray]:
    """Shared shingles with one place each in the other text, the one that goes on best."""
    order, left, right = at.order, at.left, at.right
    i = np.flatnonzero(right > left)
    if not len(i):
        return i, i
    j = order[left[i]]
    several = np.flatnonzero(right[i] - left[i] > 1)
    if len(several):
        # Of several places take the next one that goes on with the chain, else the first.
        j = j.copy()
        for k in several:
            # In the order of their places, the sort being stable.
            options = order[left[i[k]] : right[i[k]]]
            step = i[k] - i[k - 1] if k else PASSAGE
            want = j[k - 1] + step if k else 0
            first = np.searchsorted(options, want - min(step - 1, SLACK) if k else 0)
            near = options[first : first + 2]
            near = near[np.abs(near - want) <= PASSAGE] if k else near[:1]
            j[k] = near[np.argmin(np.abs(near - want))] if len(near) else options[0]
    return i, j


def aligned_spans(overlap: Overlap, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages along one shift between two texts: the longest stretches from the beginning of
    each run ``(i, j, n)`` of :func:`diagonals` to the end of another whose places are equal
    but for one in ``WEIGHT + 1``."""
    out = []
    if not len(i):
        return out
    new = np.concatenate([[True], np.diff(j - i) != 0])
    line = np.cumsum(new) - 1
    enough = (np.add.reduceat(n, np.flatnonzero(new)) >= SIMILARITY * LEAST)[line]
    # Rising with every place: what a stretch gains is the difference of its ends. Every shift
    # lies below all before it, so none gains from another.
    upto = (WEIGHT + 1) * np.cumsum(n)
    below = line * (2 * (WEIGHT + 1) * int(n.sum() + (i + n).max()))
    ends, starts = upto - WEIGHT * (i + n) - below, upto - (WEIGHT + 1) * n - WEIGHT * i - below
    # The last stretch that still gains: what may be gained from a place on never grows.
    later = np.maximum.accumulate(ends[::-1])[::-1]
    last = (i + n)[np.searchsorted(-later, -starts, "right") - 1]
    some = np.flatnonzero(enough & (last - i >= LEAST))
    at, reach = -1, -1
    for of, a, end, shift in zip(line[some].tolist(), i[some].tolist(), last[some].tolist(), (j - i)[some].tolist()):
        if of != at:
            at, reach = of, -1
        if end > reach:
            score = overlap.score(a, end, a + shift, end + shift)
            if score >= SIMILARITY:
                out.append((a, end, a + shift, end + shift, score))
                reach = end
    return out


def similar_spans(x: np.ndarray, y: np.ndarray, aligned: bool = False) -> list[tuple[int, int, int, int, float]]:
    """Maximal passages of two lists of shingle hashes: ``(x start, x end, y start, y end,
    Jaccard similarity)``, ends excluded, each of ``PASSAGE`` words and ``SIMILARITY`` or more.

    Shared shingles are chained at the places that go on best, and then from every run of
    ``SEED`` or more that no passage holds yet, at whichever of its places it stands; a chain
    that falls short is split at its widest gap and its parts are tried. A changed word takes
    ``SHINGLE`` shingles from both texts, an inserted one nearly so: a passage of the wanted
    similarity whose shingles differ from each other has a run of ``SEED``. One that repeats
    its own shingles may have none, and is found at the first places only. ``aligned`` adds the
    passages of one shift, wherever chains are split.
    """
    at = Matches(x, y)
    i, j = nearest_places(at)
    if not len(i):
        return []
    overlap = Overlap(x, at)
    breaks = np.flatnonzero((np.diff(j) <= 0) | (np.abs(np.diff(j) - np.diff(i)) > PASSAGE)) + 1
    out = []
    for p, q in zip(np.split(i, breaks), np.split(j, breaks)):
        out += similar_parts(overlap, p, q)
    i, j, n = diagonals(at)
    if aligned:
        out += aligned_spans(overlap, i, j, n)
    chains, tried = Chains(i, j, n), set()
    # Furthest end of the passages that begin at each place or before it.
    reach = np.zeros(len(x), np.int64)
    for a, b, *_ in out:
        reach[a:] = np.maximum(reach[a:], b)
    for k in np.argsort(-n, kind="stable"):
        if n[k] < SEED:
            break
        if reach[i[k]] >= i[k] + n[k]:
            continue
        parts = chains.through(int(k))
        if parts in tried:
            continue
        tried.add(parts)
        p, q = (np.concatenate([np.arange(part[d], part[d] + part[2]) for part in parts]) for d in (0, 1))
        for span in similar_parts(overlap, p, q):
            out.append(span)
            reach[span[0] :] = np.maximum(reach[span[0] :], span[1])
    return outermost(out)


SPAN = (
    "doc_id long, body long, start_word long, n_words long, start_char long, n_chars long, "
    "other_doc_id long, other_start_word long, similarity double"
)


def verified(pairs: DataFrame, docs: DataFrame, text: str, aligned: bool = False) -> DataFrame:
    """Compare the texts of each pair, word by word; ``body`` is a hash of the document's text."""
    import pyarrow as pa

    names = [part.split()[0] for part in SPAN.split(", ")]
    texts = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    # Both joins name the same columns of the same table, so its texts are shuffled once.
    mine = pairs.hint("merge").join(texts, F.col("doc") == F.col("doc_id")).select("doc", "other", F.col("text").alias("mine"))
    both = mine.hint("merge").join(texts, F.col("other") == F.col("doc_id"))

    def spans(doc, body, other, text, other_text, known, last):
        # Rows arrive by the other document, so its hashes serve many in turn.
        if last.get("doc") != other or last["text"] != other_text:
            last.update(doc=other, text=other_text, hashes=shingles(word_hashes(other_text, known)))
        y = last["hashes"]
        x = y if text == other_text else shingles(word_hashes(text, known))
        found = [(0, len(x), 0, len(x), 1.0)] if x is y and len(x) else similar_spans(x, y, aligned)
        if not found:
            return
        starts, ends = word_places(text)
        for a, b, c, _, s in found:
            start, end = int(starts[a]), int(ends[b + SHINGLE - 2])
            yield doc, body, a, b + SHINGLE - 1 - a, start, end - start, other, c, s

    def run(frames):
        known, last = WordHashes(), {}
        for frame in frames:
            out = []
            for row in zip(*(frame.column(n).to_pylist() for n in ("doc", "body", "other", "text", "other_text"))):
                out += spans(*row, known, last)
            columns = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for n, c in zip(names, columns)],
                names=names,
            )

    rows = both.select("doc", F.xxhash64("mine").alias("body"), "other", F.col("mine").alias("text"), F.col("text").alias("other_text"))
    return rows.mapInArrow(run, SPAN).distinct()


def repeated_passages(docs: DataFrame, text: str = "text", every: bool = True) -> DataFrame:
    """Passages of at least ``PASSAGE`` words that an earlier document also has.

    One row per passage and earlier document: place in words and characters, the other
    document (its doc_id is smaller) and its place, and the Jaccard similarity of their sets
    of five-word shingles, ``SIMILARITY`` or more. Words are runs between ASCII white space;
    A-Z count as a-z. The first document of a group of copies of a passage has no row, each
    other one is compared with the first and with its predecessor, so a group of any size gives
    rows in proportion and none of its members is missed; different passages are compared with
    each other, by the first of their groups. Without ``every``, near copies too are compared
    with one of the first members of each class alone, where that surely links them around an
    equal run: texts that ``every`` links are then linked through others, and rows grow in
    proportion to a group of near copies, not with its square.

    A hash function over runs of ``GRAM`` shingles groups all runs of ``SEED`` of a text into
    compact windows; windows with one minimum meet, so texts with an equal run meet for sure.
    Those whose shingles agree around it are verified on their words.

    Null texts and null doc_ids take no part; rows that repeat a doc_id with the same text count
    as one; different texts under one doc_id are told apart by ``body``, the hash of the text
    that holds the passage, and not compared with each other; texts below ``PASSAGE`` words have no passage; an empty table gives no rows; other columns
    are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    keys = staged(shared_keys(rows), "keys")
    pairs = candidates(surroundings(rows, keys), every)
    return verified(staged(pairs, "pairs"), docs, text, aligned=not every)


def passage_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of :func:`repeated_passages` that link each document to its class, and
    ``class_id``: the smallest doc_id that passages lead to, from one document to the next.

    The document of that doc_id has no row; documents of different classes share no passage.
    """
    found = staged(repeated_passages(docs, text, every=False), "passages")
    classes = connected_components(found.select(F.col("doc_id").alias("a"), F.col("other_doc_id").alias("b")))
    classes = classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    return found.join(classes, "doc_id")


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the repeated passages: their words go, the rest of the text stays.

    All columns stay, whatever their names; ``n_chars``, where present, is counted anew for
    changed texts. Each text loses its own passages, also where several texts have one doc_id.
    Null texts and rows without doc_id stay as they are; an empty table stays empty.
    """
    found = staged(repeated_passages(docs, text, every=False), "passages")
    spans = found.groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_set(F.struct(
            F.col("start_char").alias("a"), (F.col("start_char") + F.col("n_chars")).alias("b")
        ))).alias("spans")
    )
    # The row travels as one value, so that its columns can't clash with any of ours.
    value = F.col(text).cast("string")
    rows = docs.select(
        F.struct("*").alias("row"), value.alias("value"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(value).alias("body"),
    )
    joined = rows.join(spans.hint("merge"), ["doc_id", "body"], "left")
    # Walk through the sorted spans with the end of what is dealt with so far.
    value = F.col("value")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("done"))
    walked = F.aggregate(
        "spans", start,
        lambda s, x: F.struct(
            F.concat(s["kept"], F.substring(value, (s["done"] + 1).cast("int"),
                     F.greatest(F.lit(0), x["a"] - s["done"]).cast("int"))).alias("kept"),
            F.greatest(s["done"], x["b"]).alias("done"),
        ),
        lambda s: F.concat(s["kept"], F.substring(value, (s["done"] + 1).cast("int"), F.length(value))),
    )
    same = F.col("spans").isNull()

    def column(name: str, kind: str):
        old = F.col("row").getField(name)
        if name == text:
            return F.when(same, old).otherwise(walked).alias(name)
        if name == "n_chars":
            return F.when(same, old).otherwise(F.length(walked).cast(kind)).alias(name)
        return old.alias(name)

    return joined.select(*[column(name, kind) for name, kind in docs.dtypes])
