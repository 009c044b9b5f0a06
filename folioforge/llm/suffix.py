"""Removal of repeated byte strings by enhanced suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (in a smaller doc_id,
or earlier in the same document). Matches do not cross documents and are judged on the input.

A suffix array of the whole corpus cannot be built in one place, so equal strings are first
brought together. Every window of LENGTH bytes belongs to a content-defined block (see
``anchors``); equal windows have the same anchor.

1. Blocks are named by two 64-bit hashes (anchor, all bytes) and dealt by their anchor. Of blocks
   with the same bytes all but the earliest are repeats as a whole; those inside one batch of rows
   are found there, so of a block that any number of documents share only one leaves each batch.
2. Where an anchor is left with several different blocks, their bytes are fetched and gathered,
   and the enhanced suffix array of each gathering gives the maximal repeats with all their
   places; all but the earliest place are repeats.
3. Anchors with over HOT different blocks, or over LOCAL_HOT in one batch (a line that many
   documents share, between different neighbours), are not gathered: their windows are dealt one
   by one, by 128 bits of hash, first occurrences only. Blocks of anchors that are hot in a batch
   are dealt by all their bytes, and the anchor's part is told, so that no part gets more than
   LOCAL_HOT blocks of one anchor from a batch.

Defined results: a null text is empty; a text below LENGTH bytes loses nothing; rows without
doc_id neither lose bytes nor make others lose any; rows that repeat a doc_id and its text count
as one document and get equal results. An empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import anchors
from folioforge.llm.anchors import LENGTH, PIECE
from folioforge.llm.repeats import repeated_spans
from folioforge.llm.shingles import mix64
from folioforge.llm.util import bound_batches, materialize

#: Text bytes whose blocks share a part of the shuffle, about; more where there would be more than MOST_PARTS.
PART_BYTES, MOST_PARTS = 12 << 20, 100_000
#: Different blocks with one anchor from which on its windows are dealt one by one: in all, and in one batch of rows.
HOT, LOCAL_HOT = 512, 64
#: Bytes whose suffixes are sorted at once.
GATHER_BYTES = 3 << 19

_U64, _I64 = np.uint64, np.int64


def _pack(*columns: np.ndarray) -> bytes:
    """Integer columns of equal length in one compressed blob."""
    compress = zstandard.ZstdCompressor(level=1).compress
    parts = [struct.pack("<I", len(columns[0]))]
    for c in columns:
        raw = compress(np.ascontiguousarray(c, _I64).view(np.uint8).reshape(-1, 8).T.tobytes())
        parts.append(struct.pack("<I", len(raw)) + raw)
    return b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", blob), 4, []
    decompress = zstandard.ZstdDecompressor().decompress
    while at < len(blob):
        (size,) = struct.unpack_from("<I", blob, at)
        raw = np.frombuffer(decompress(blob[at + 4 : at + 4 + size]), np.uint8).reshape(8, n).T
        out.append(np.ascontiguousarray(raw).view(_I64).reshape(n))
        at += 4 + size
    return out


def _pieces(ids: list[int], texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(ids, offsets, bytes) of about PIECE bytes each; longer texts are cut between windows."""
    out: tuple[list, list, list] = ([], [], [])
    size = 0
    for doc, text in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if size and size + len(part) > PIECE + LENGTH:
                yield out
                out, size = ([], [], []), 0
            for column, value in zip(out, (doc, at, part), strict=True):
                column.append(value)
            size += len(part)
    if size:
        yield out


def _by_part(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.empty(0, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(part[a]), [c[a:b] for c in columns]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _later(start: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows, sorted in their groups, that are not at the place of the group's first row."""
    first = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
    return (doc != doc[first]) | (place != place[first])


#: Kinds of rows: bytes that go, blocks to be gathered, blocks whose windows are dealt one by one, blocks, and hot anchors.
GONE, GATHER, SINGLE, BLOCK, FLAG = range(5)


def _named_blocks(docs: DataFrame, parts: int, local_hot: int) -> DataFrame:
    """(part, kind, blob): blocks of the documents and what is known of them from one batch, packed for each part."""

    def dealt(kind: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        part = (key.view(_U64) % _U64(parts)).astype(_I64)
        return ((p, kind, _pack(*c)) for p, c in _by_part(part, list(columns)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8") for t in batch.column(1).to_pylist()]
            found: list[tuple] = []
            for ids, offsets, raw in _pieces(batch.column(0).to_pylist(), texts):
                data = np.frombuffer(b"".join(raw), np.uint8)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                anchor, whole, start, windows = anchors.blocks(data, bounds)
                text = np.searchsorted(bounds, start, side="right") - 1
                found.append((anchor.view(_I64), whole.view(_I64), np.array(ids, _I64)[text], start - bounds[text] + np.array(offsets, _I64)[text], windows))
            if not found:
                continue
            columns = _sorted([np.concatenate(z) for z in zip(*found, strict=True)])
            anchor, whole, doc, start, windows = columns
            first = _starts(anchor, whole)
            gone = _later(first, doc, start)
            rows = []
            if gone.any():
                spans = _joined(doc[gone], start[gone], windows[gone] + LENGTH - 1)
                rows += dealt(GONE, mix64(spans[0].view(_U64)), *spans)
            columns = [c[first] for c in columns]
            group = _starts(columns[0])
            hot = np.bincount(np.cumsum(group) - 1)[np.cumsum(group) - 1] > local_hot if len(group) else group
            rows += dealt(BLOCK, columns[0][~hot], *(c[~hot] for c in columns))
            rows += dealt(SINGLE, columns[1][hot], *(c[hot] for c in columns))
            rows += dealt(FLAG, columns[0][hot & group], columns[0][hot & group])
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "blob"])

    return docs.mapInArrow(run, "part int, kind int, blob binary")


def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns anchor, whole, doc, start, windows in their order."""
    anchor, whole, doc, start, _ = columns
    order = np.lexsort((start, doc, whole, anchor))
    return [c[order] for c in columns]


_SPANS = "kind int, doc_id bigint, start bigint, length bigint, anchor bigint"


def _spans(kind: int, doc: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 100_000):
        s = slice(i, i + 100_000)
        other = anchor[s] if anchor is not None else np.zeros(len(doc[s]), _I64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc[s]), kind, np.int32)), pa.array(doc[s].astype(_I64)), pa.array(start[s].astype(_I64)), pa.array(length[s].astype(_I64)), pa.array(other.astype(_I64))],
            names=["kind", "doc_id", "start", "length", "anchor"],
        )


def _compare_blocks(named: DataFrame, most: int) -> DataFrame:
    """Rows of _SPANS: repeats of whole blocks, and what is to be looked at more closely."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = _unpack(blob)
                if kind == GONE:
                    yield from _spans(GONE, *columns)
                else:
                    found.setdefault((part, kind), []).append(columns)
        flags = {part: np.unique(np.concatenate([c[0] for c in rows])) for (part, kind), rows in found.items() if kind == FLAG}
        for part, kind in [k for k in found if k[1] != FLAG]:
            anchor, whole, doc, start, windows = _sorted([np.concatenate(z) for z in zip(*found.pop((part, kind)), strict=True)])
            block, group = _starts(anchor, whole), _starts(anchor)
            gone = _later(block, doc, start)
            yield from _spans(GONE, doc[gone], start[gone], windows[gone] + LENGTH - 1)
            number = np.cumsum(group) - 1
            variants = np.bincount(number[block])[number]
            single = variants > most
            if kind == SINGLE:
                single = np.ones(len(anchor), bool)
            elif part in flags:
                single |= np.isin(anchor, flags[part])
            for to, rows in ((GATHER, block & (variants > 1) & ~single), (SINGLE, block & single)):
                yield from _spans(to, doc[rows], start[rows], windows[rows] + LENGTH - 1, anchor[rows])

    return named.mapInArrow(run, _SPANS)


def _fetch(wanted: DataFrame, parts: int) -> DataFrame:
    """(part, kind, blob, raw): the bytes of the blocks to gather, and hashed windows of the others."""

    def windows(text: bytes, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(text, np.uint8, length, start)
        n = length - LENGTH + 1
        return *anchors.window_hashes(data, n), np.arange(start, start + n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            parts_, kinds, blobs, raws = [], [], [], []
            doc, place, anchor, body, single = [], [], [], [], []
            for d, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8")
                for a in asked:
                    if a["start"] + a["length"] > len(raw):
                        continue  # another row with this doc_id
                    if a["kind"] == SINGLE:
                        h, g, at = windows(raw, a["start"], a["length"])
                        single.append((h, g, np.full(len(at), d, _I64), at))
                    else:
                        doc.append(d)
                        place.append(a["start"])
                        anchor.append(a["anchor"])
                        body.append(raw[a["start"] : a["start"] + a["length"]])
            if doc:
                part = (np.array(anchor, _I64).view(_U64) % _U64(parts)).astype(_I64)
                for p, (i,) in _by_part(part, [np.arange(len(doc))]):
                    rows = i.tolist()
                    parts_.append(p)
                    kinds.append(GATHER)
                    blobs.append(_pack(np.array(anchor, _I64)[i], np.array(doc, _I64)[i], np.array(place, _I64)[i], np.array([len(body[k]) for k in rows], _I64)))
                    raws.append(zstandard.compress(b"".join(body[k] for k in rows), 1))
            if single:
                h, g, d, at = (np.concatenate(z) for z in zip(*single, strict=True))
                order = np.lexsort((at, d, g, h))
                h, g, d, at = (c[order] for c in (h, g, d, at))
                keep = ~_later(_starts(h, g), d, at)  # of equal windows the later ones are known to go
                gone = _joined(d[~keep], at[~keep], np.full(int((~keep).sum()), LENGTH))
                for p, c in _by_part((mix64(gone[0].view(_U64)) % _U64(parts)).astype(_I64), list(gone)):
                    parts_.append(p)
                    kinds.append(GONE)
                    blobs.append(_pack(*c))
                    raws.append(b"")
                h, g, d, at = (c[keep] for c in (h, g, d, at))
                for p, c in _by_part((mix64(h) % _U64(parts)).astype(_I64), [h.view(_I64), g.view(_I64), d, at]):
                    parts_.append(p)
                    kinds.append(SINGLE)
                    blobs.append(_pack(*c))
                    raws.append(b"")
            yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary()), pa.array(raws, pa.binary())], names=["part", "kind", "blob", "raw"])

    return wanted.mapInArrow(run, "part int, kind int, blob binary, raw binary")


def _compare_bytes(fetched: DataFrame) -> DataFrame:
    """Rows of _SPANS: the repeats that are shorter than a block."""

    def gathered(rows: list[tuple[list[np.ndarray], bytes]]) -> Iterator[pa.RecordBatch]:
        anchor, doc, place, size = (np.concatenate(z) for z in zip(*(r[0] for r in rows), strict=True))
        data = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
        at = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        group = np.flatnonzero(_starts(anchor[order]))
        ends = np.concatenate([group[1:], [len(order)]])
        total = np.cumsum(size[order])
        i = 0
        while i < len(group):  # blocks of one anchor stay together
            base = total[group[i]] - size[order[group[i]]]
            j = max(i, int(np.searchsorted(total[ends - 1], base + GATHER_BYTES, side="right")) - 1)
            own = order[group[i] : ends[j]]
            n = size[own]
            bounds = np.concatenate([[0], np.cumsum(n)])
            index = np.repeat(at[own] - bounds[:-1], n) + np.arange(bounds[-1])
            yield from _spans(GONE, *repeated_spans(data[index], bounds, LENGTH, doc[own], place[own]))
            i = j + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        singles: dict[int, list] = {}
        for batch in batches:
            for part, kind, blob, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == GATHER:
                    blocks.setdefault(part, []).append((_unpack(blob), zstandard.decompress(raw)))
                elif kind == GONE:
                    yield from _spans(GONE, *_unpack(blob))
                else:
                    singles.setdefault(part, []).append(_unpack(blob))
        for part in list(blocks):
            yield from gathered(blocks.pop(part))
        for part in list(singles):
            h, g, doc, place = (np.concatenate(z) for z in zip(*singles.pop(part), strict=True))
            order = np.lexsort((place, doc, g, h))
            h, g, doc, place = (c[order] for c in (h, g, doc, place))
            gone = _later(_starts(h, g), doc, place)
            yield from _spans(GONE, *_joined(doc[gone], place[gone], np.full(int(gone.sum()), LENGTH)))

    return fetched.mapInArrow(run, _SPANS)


def _joined(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the bytes in the given spans; spans that touch are one run."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = start + length[order]
    if not len(doc):
        return doc, start, end
    new = _starts(doc)
    number = np.cumsum(new) - 1
    shift = number * (int(end.max()) + 2)  # spans of one document never reach into the next
    reach = np.maximum.accumulate(end + shift)
    new[1:] |= start[1:] + shift[1:] > reach[:-1]
    cut = np.flatnonzero(new)
    last = np.concatenate([cut[1:], [len(doc)]]) - 1
    return doc[cut], start[cut], reach[last] - shift[last] - start[cut]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, local_hot: int = LOCAL_HOT) -> DataFrame:
    """(doc_id, start, length): spans of bytes to remove; they may overlap."""
    spans, more = _find(docs, id_col, text_col, hot, local_hot)
    return spans.unionByName(more)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def _find(docs: DataFrame, id_col: str, text_col: str, hot: int, local_hot: int) -> tuple[DataFrame, DataFrame]:
    bound_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col).filter("doc_id is not null")
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-total // PART_BYTES)))
    named = _named_blocks(texts, parts, local_hot).repartitionById(parts, F.col("part"))
    close = materialize(_compare_blocks(named, hot))
    ask = close.filter(F.col("kind") != GONE).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "start", "length", "anchor")).alias("asked"))
    wanted = texts.join(ask, "doc_id").select("doc_id", "text", "asked")
    fetched = _fetch(wanted, parts).repartitionById(parts, F.col("part"))
    cols = ["doc_id", "start", "length"]
    return close.filter(F.col("kind") == GONE).select(*cols), _compare_bytes(fetched).select(*cols)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = True, hot: int = HOT, local_hot: int = LOCAL_HOT) -> DataFrame:
    """One row per document: doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans, kept_sha256."""
    spans, more = _find(docs, id_col, text_col, hot, local_hot)
    gone = spans.unionByName(more).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("gone"))
    texts = _texts(docs, id_col, text_col)
    rows = texts.filter("doc_id is not null").join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    rows = rows.unionByName(texts.filter("doc_id is null").withColumn("gone", F.lit(None).cast(rows.schema["gone"].dataType)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            lists = batch.column(2)
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8")
                own = lists[i].values if lists[i].is_valid else None
                if own is not None and len(own):
                    start, length = (own.field(k).to_numpy() for k in ("start", "length"))
                    fits = start + length <= len(raw)
                    _, start, length = _joined(np.zeros(int(fits.sum()), _I64), start[fits], length[fits])
                else:
                    start = length = np.empty(0, _I64)
                parts, at = [], 0
                for s, n in zip(start.tolist(), length.tolist(), strict=True):
                    parts.append(raw[at:s])
                    at = s + n
                parts.append(raw[at:])
                rest = b"".join(parts)
                for column, value in zip(out, (rest, len(raw), len(raw) - len(rest), len(start), hashlib.sha256(rest).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            own_columns = [(n, pa.array(c, t)) for n, c, t in zip(names, out, kinds, strict=True) if kept or n != "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(c for _, c in own_columns)], names=["doc_id", *(n for n, _ in own_columns)])

    schema = f"doc_id bigint, {'kept binary, ' if kept else ''}n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
