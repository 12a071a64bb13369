"""Rows that fail to parse: a quote-aware finite-state tokenizer (problem 3).

Records are tokenized by a five-state machine over bytes.  An Arrow batch is one
byte stream with a mark after each record; the stream is cut into chunks of equal
length, every chunk's map from start state to end state is computed for all
chunks at once, the maps are composed from left to right, and a second pass with
the now known start states gives each byte its state.  A record thus costs the
same whether it is short, or so long that it spans many chunks.

Fields are cut from the states with numpy; typed values come from one vectorised
cast.  A broken record keeps the reason and the byte offset at which it broke.

Defined results: a null record is an empty one, thus of one field
(``column_count``, offset 0); quoting goes before column count and column count
before values; the offset of a column-count fault is where the ninth field begins
or the record's end, that of a value fault is where the field begins; line 1 of a
file is its header and no record; rows with null line_no count as records; other
columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
_COMMA, _QUOTE, _OTHER, _END = range(4)

# next state by (symbol class, state); the end of a record starts a new one
_NEXT = np.array(
    [
        [START, START, QUOTED, START, BROKEN],
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],
        [START, START, START, START, START],
    ],
    dtype=np.uint8,
)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[ord(",")] = _COMMA
_CLASS[ord('"')] = _QUOTE

FIELDS = ("timestamp", "open", "high", "low", "close", "volume", "symbol", "ignored")
NUMBERS = ("open", "high", "low", "close", "volume")
DECIMAL = r"^[ \t]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The state map of two adjoining pieces: ``first``, then ``then``."""
    return then[first]


def piece_map(symbols: np.ndarray) -> np.ndarray:
    """End state per start state of one piece of a stream of symbol classes."""
    return chunk_maps(symbols[None, :])[0]


def chunk_maps(chunks: np.ndarray) -> np.ndarray:
    """End state per chunk and start state; chunks is a matrix of symbol classes."""
    state = np.broadcast_to(np.arange(5, dtype=np.uint8), (len(chunks), 5)).copy()
    for k in range(chunks.shape[1]):
        state = _NEXT[chunks[:, k][:, None], state]
    return state


def states_before(symbols: np.ndarray, chunk: int = 256) -> np.ndarray:
    """The machine's state before each symbol of a stream that starts a record."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.uint8)
    pad = -n % chunk
    grid = np.concatenate([symbols, np.full(pad, _END, dtype=np.uint8)]).reshape(-1, chunk)
    maps = chunk_maps(grid)
    enter = np.zeros(len(grid), dtype=np.uint8)
    at = START
    for i, m in enumerate(maps):
        enter[i] = at
        at = m[at]
    out = np.empty(grid.shape, dtype=np.uint8)
    state = enter
    for k in range(chunk):
        out[:, k] = state
        state = _NEXT[grid[:, k], state]
    return out.reshape(-1)[:n]


def _stream(records: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and symbol classes of all records, each with an end mark; record ends."""
    text = pc.fill_null(records.cast(pa.large_string()), "")
    sizes = np.diff(np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1])
    begin = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset]
    raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[begin : begin + sizes.sum()]
    ends = np.cumsum(sizes + 1) - 1
    place = np.ones(len(raw) + len(sizes), dtype=bool)
    place[ends] = False
    data = np.zeros(len(place), dtype=np.uint8)
    data[place] = raw
    symbols = _CLASS[data]
    symbols[ends] = _END
    return data, symbols, ends


def tokenize(records: pa.Array) -> dict[str, np.ndarray | list[pa.Array]]:
    """Per record: quoting fault offset (-1: none), field count, where field k begins, its text."""
    data, symbols, ends = _stream(records)
    n = len(ends)
    before = states_before(symbols)
    owner = np.zeros(len(symbols), dtype=np.int64)
    owner[ends[:-1] + 1] = 1 if n > 1 else 0
    owner = np.cumsum(owner)
    begins = np.concatenate([[0], ends[:-1] + 1]) if n else np.zeros(0, dtype=np.int64)

    # a quoting fault: the step into the broken state, or a record that ends inside quotes
    after = _NEXT[symbols, before]
    hit = np.flatnonzero((after == BROKEN) & (before != BROKEN))
    fault = np.full(n, -1, dtype=np.int64)
    fault[owner[hit]] = hit - begins[owner[hit]]
    open_end = before[ends] == QUOTED
    fault[open_end] = (ends - begins)[open_end]

    split = np.flatnonzero((symbols == _END) | ((symbols == _COMMA) & ((before == START) | (before == PLAIN) | (before == CLOSED))))
    of = owner[split]
    count = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if n else np.zeros(0, dtype=np.int64)
    left = np.where(np.arange(len(split)) == first[of], begins[of], np.concatenate([[0], split[:-1] + 1]) if len(split) else 0)
    ninth = np.where(count > 8, split[np.minimum(first + 7, len(split) - 1)] + 1 - begins, ends - begins) if n else ends
    whole = (fault < 0) & (count == 8)
    rows = np.flatnonzero(whole)
    texts, starts = [], []
    for k in range(8):
        s, e = left[first[rows] + k], split[first[rows] + k]
        texts.append(_cut(data, s, e))
        starts.append(s - begins[rows])
    return {"fault": fault, "count": count, "ninth": ninth, "rows": rows, "starts": starts, "texts": texts}


def _cut(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The texts data[s:e] without their outer quotes, inner ones undoubled."""
    quoted = (e - s >= 2) & (data[np.minimum(s, len(data) - 1)] == ord('"')) if len(s) else np.zeros(0, dtype=bool)
    s, e = s + quoted, e - quoted
    size = e - s
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    flat = np.repeat(s - offsets[:-1], size) + np.arange(offsets[-1])
    out = pa.StringArray.from_buffers(len(s), pa.py_buffer(offsets), pa.py_buffer(data[flat].tobytes()))
    return pc.replace_substring(out, '""', '"')


def _judge(records: pa.Array) -> dict[str, pa.Array]:
    n = len(records)
    tok = tokenize(records)
    reason = np.full(n, None, dtype=object)
    offset = np.full(n, -1, dtype=np.int64)
    bad = tok["fault"] >= 0
    reason[bad], offset[bad] = "quoting", tok["fault"][bad]
    odd = ~bad & (tok["count"] != 8)
    reason[odd], offset[odd] = "column_count", tok["ninth"][odd]
    rows = tok["rows"]
    text = dict(zip(FIELDS, tok["texts"]))
    number, where = {}, {}
    for name in NUMBERS:
        plain = pc.match_substring_regex(text[name], DECIMAL)
        cast = pc.cast(pc.if_else(plain, pc.utf8_ltrim(pc.utf8_trim(text[name], " \t"), "+"), None), pa.float64())
        x = np.asarray(cast.to_numpy(zero_copy_only=False), dtype=float)
        number[name] = np.where(np.isinf(x), np.nan, x)
        where[name] = tok["starts"][FIELDS.index(name)]
    o, h, lo, c, v = (number[k] for k in NUMBERS)
    far = np.full(len(rows), -1, dtype=np.int64)
    checks = [(np.isnan(number[k]), k) for k in NUMBERS]
    with np.errstate(invalid="ignore"):
        checks += [((h < lo) | (h < o) | (h < c), "high"), ((lo > o) | (lo > c), "low"), (v < 0, "volume")]
    for wrong, k in checks:
        hit = wrong & (far < 0)
        far[hit] = where[k][hit]
    wrong = far >= 0
    reason[rows[wrong]], offset[rows[wrong]] = "value", far[wrong]
    good = rows[~wrong]
    out = {"reason": pa.array(reason, pa.string()), "offset": pa.array(offset, pa.int64(), mask=offset < 0)}
    pick = pa.array(np.flatnonzero(~wrong))
    slot = np.full(n, -1, dtype=np.int64)
    slot[good] = np.arange(len(good))
    index = pa.array(slot, mask=slot < 0)
    for name in ("timestamp", "symbol", "ignored"):
        out[name] = text[name].take(pick).take(index)
    for name in NUMBERS:
        out[name] = pa.array(number[name]).take(pick).take(index)
    return out


def parse_records(df: DataFrame, text: str = "raw_line", header: str | None = "line_no") -> DataFrame:
    """Each record's typed bar, or the reason and byte offset of its fault.

    Keeps the columns of ``df`` but ``text`` (a column of ``df`` whose name is
    also a result's gets the suffix ``_given``) and adds reason, offset,
    timestamp, symbol, ignored (text) and open, high, low, close, volume.
    """
    added = "reason string, offset bigint, timestamp string, symbol string, ignored string, " + ", ".join(f"{n} double" for n in NUMBERS)
    new = {"reason", "offset", "timestamp", "symbol", "ignored", *NUMBERS}
    rest = [c for c in df.columns if c != text]
    named = {c: f"{c}_given" if c in new else c for c in rest}
    rows = df if header is None else df.where(F.coalesce(F.col(header) > 1, F.lit(True)))
    rows = rows.select(*(F.col(c).alias(named[c]) for c in rest), F.col(text).cast("string").alias("_record"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{named[c]}` {kinds[c]}" for c in rest), added])
    kept = [named[c] for c in rest]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _judge(b.column("_record"))
            cols = [b.column(k) for k in kept] + [got[k] for k in ("reason", "offset", "timestamp", "symbol", "ignored", *NUMBERS)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "reason", "offset", "timestamp", "symbol", "ignored", *NUMBERS])

    return rows.mapInArrow(work, schema)
