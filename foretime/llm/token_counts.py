"""Token counts of sections by the places of the tokens in the whole text.

A document is encoded once, as a whole. Its tokens' byte spans are joined with the
sections' spans by order (both are sorted), and a token that crosses a border is
allocated by a stated rule:

``start``   to the section that holds its first byte;
``end``     to the section that holds its last byte;
``split``   to each section by its share of the token's bytes.

Sections are the fields of a record or, inside a text, its lines; each line feed
belongs to the line that it ends. Several fields are encoded as one text, joined by
line feeds, each of which belongs to the field before it.

Cases: a null field is empty; an empty text is one empty section without tokens;
rows with equal ids stay separate rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.llm.common import rows_of, sized_groups
from foretime.llm.tokens import default_tokenizer, encoder

RULES = ("start", "end", "split")
BATCH_BYTES = 4 << 20


def attribute(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [bounds[i], bounds[i+1]); tokens are the runs that end at ``token_ends``."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    n = len(bounds) - 1
    if rule == "split":
        # tokens up to a place, a crossed token counted by its share
        upto = np.interp(bounds, np.concatenate(([0], token_ends)), np.arange(len(token_ends) + 1)) if len(token_ends) else np.zeros(n + 1)
        return np.diff(upto)
    at = np.searchsorted(bounds, starts if rule == "start" else token_ends - 1, "right") - 1
    return np.bincount(np.clip(at, 0, n - 1), minlength=n).astype(np.float64)


def line_bounds(raw: bytes) -> np.ndarray:
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if len(feeds) and feeds[-1] == len(raw):
        feeds = feeds[:-1]
    return np.concatenate(([0], feeds, [len(raw)]))


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", fields: tuple[str, ...] = ("text",), by_line: bool = True,
                   rule: str = "start", tokenizer: str | None = None) -> DataFrame:
    """(id, section, name, n_bytes, n_tokens double, n_total: tokens of the whole document).

    ``section`` counts from 0; ``name`` is the field, or the field's line."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if by_line and len(fields) != 1:
        raise ValueError("lines are sections of one field")
    tokenizer = tokenizer or default_tokenizer()
    names = [f"f{i}" for i in range(len(fields))]
    rows = docs.select(F.col(doc_id).alias("id"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names, strict=True)])
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        wide = enc.widths
        for b in batches:
            ids, at = b.column("id"), 0
            joined = (("\n".join(x or "" for x in r) if len(r) > 1 else r[0] or "", r) for r in rows_of([b], *names))
            for group in sized_groups(joined, 0, BATCH_BYTES):
                takes, out = [], ([], [], [], [], [])
                for i, ((text, parts), tokens) in enumerate(zip(group, enc.encode([t for t, _ in group]), strict=True)):
                    raw = text.encode("utf-8", "surrogatepass")
                    ends = np.cumsum(wide[tokens])
                    if len(ends) and ends[-1] != len(raw):
                        raise ValueError("token bytes do not add up to the text")
                    bounds = line_bounds(raw) if by_line else np.cumsum([0, *[len((x or "").encode("utf-8", "surrogatepass")) + (k < len(parts) - 1) for k, x in enumerate(parts)]])
                    n = attribute(ends, bounds, rule)
                    takes += [at + i] * len(n)
                    for to, values in zip(out, (range(len(n)), [fields[0]] * len(n) if by_line else fields, np.diff(bounds), n, [len(ends)] * len(n)), strict=True):
                        to.extend(values)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(takes, pa.int64())), *[pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64()), strict=True)]],
                    names=["id", "section", "name", "n_bytes", "n_tokens", "n_total"])
                at += len(group)

    return rows.mapInArrow(count, f"id {kind}, section long, name string, n_bytes long, n_tokens double, n_total long").withColumnRenamed("id", doc_id)
