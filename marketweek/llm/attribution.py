"""Token counts of fields and sections by the character offsets of whole-document tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweek.llm.bpe import batches, encoder
from marketweek.llm.storage import ship

#: How a token across a boundary is counted: whole, for the section with most of its bytes (the
#: earlier one of equals) or with its first byte; or in shares of its bytes.
RULES = ("most", "first", "shares")


def allocate(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section: ``ends`` are the tokens' ends in bytes, sections are sorted and
    don't overlap. Bytes of no section count for none."""
    begins = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(starts))
    if not len(ends) or not len(starts):
        return out
    if rule == "first":
        at = np.searchsorted(starts, begins, "right") - 1
        hit = (at >= 0) & (begins < stops[np.maximum(at, 0)])
        np.add.at(out, at[hit], 1)
        return out
    # Interval join: the sections from the first that ends behind a token's begin to the last
    # that starts before its end.
    low, high = np.searchsorted(stops, begins, "right"), np.searchsorted(starts, ends, "left")
    n = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(ends)), n)
    section = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[token]
    shared = np.minimum(ends[token], stops[section]) - np.maximum(begins[token], starts[section])
    token, section, shared = token[shared > 0], section[shared > 0], shared[shared > 0]
    if rule == "shares":
        np.add.at(out, section, shared / (ends - begins)[token])
        return out
    order = np.lexsort((section, -shared, token))
    first = order[np.concatenate([[True], np.diff(token[order]) != 0])] if len(order) else order
    np.add.at(out, section[first], 1)
    return out


def attribute(docs: DataFrame, sections: Column | None = None, text: str = "text", rule: str = "most") -> DataFrame:
    """Tokens of every section of every document; one row per section.

    Each whole text is encoded once. Its tokens' byte spans follow from the vocabulary, and are
    joined to the sections, ``array<struct<name, start, stop>>`` in code points (lines of the
    text when None), sorted and apart. ``rule`` is one of ``RULES``. The tokens of all lines
    add up to ``doc_tokens``.

    A null or empty text has one empty line with no tokens; null sections give no rows;
    sections beyond the text's end have no tokens; repeated rows and null doc_ids stay; an
    empty table gives no rows; other columns are ignored.
    """
    import pyarrow as pa

    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = sections is None
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), value.alias("text"),
        (F.lit(None).cast("array<struct<name:string,start:long,stop:long>>") if lines else
         sections.cast("array<struct<name:string,start:long,stop:long>>")).alias("sections"),
    )

    def run(frames):
        codes = encoder()
        sizes = codes.bytes_of
        for doc_ids, texts, given in batches(frames, ["doc_id", "text", "sections"], "text"):
            ids, counts = codes.encode(texts)
            cuts = np.cumsum(counts)
            columns = [[] for _ in range(7)]
            for k, t in enumerate(texts):
                ends = np.cumsum(sizes[ids[cuts[k] - counts[k] : cuts[k]]])
                raw = np.frombuffer(t.encode(), np.uint8)
                if lines:
                    stops = np.append(np.flatnonzero(raw == 10) + 1, len(raw))
                    starts = np.concatenate([[0], stops[:-1]])
                    names = [f"line {n}" for n in range(len(starts))]
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    spans = points[starts], points[stops]
                else:
                    given_k = [s for s in given[k] or [] if s is not None]
                    names = [s["name"] for s in given_k]
                    spans = tuple(np.array([s[p] or 0 for s in given_k], np.int64) for p in ("start", "stop"))
                    first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    starts, stops = (first[np.clip(s, 0, len(first) - 1)] for s in spans)
                got = allocate(ends, starts, stops, rule)
                n = len(names)
                for column, x in zip(columns, ([doc_ids[k]] * n, list(range(n)), names, spans[0].tolist(),
                                               spans[1].tolist(), got.tolist(), [int(counts[k])] * n)):
                    column.extend(x)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "section", "name", "start", "stop", "tokens", "doc_tokens"],
            )

    return rows.mapInArrow(
        run, "doc_id long, section int, name string, start long, stop long, tokens double, doc_tokens long"
    )
