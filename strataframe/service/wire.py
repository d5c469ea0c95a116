"""What goes over the wire: JSON for small things, Arrow streams for records and values."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa

from ..functions.digests import digest_of

RECORDS = pa.schema([(c, pa.string()) for c in ("kind", "col", "sample_key", "subsample_key", "digest", "commit")])
VALUES = pa.schema([("digest", pa.string()), ("kind", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary()), ("text", pa.string()), ("nbytes", pa.int64())])
DIGESTS = pa.schema([("digest", pa.string())])
#: Rows of a message, and bytes of values in one.
ROWS, BYTES = 1_000, 16_000_000


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.Table:
    with pa.ipc.open_stream(body) as got:
        return got.read_all()


def messages(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.Table]:
    """Tables of bounded rows and bytes; a value larger than that goes alone."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(schema.names).cast(schema)
        sizes = table["nbytes"].to_pylist() if "nbytes" in schema.names else [0] * table.num_rows
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= ROWS or held + (n or 0) > BYTES):
                yield table.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < table.num_rows:
            yield table.slice(start)


def unsound(values: pa.Table) -> list[str]:
    """Digests of rows whose value has another one."""
    out = []
    for r in values.to_pylist():
        data = r["text"].encode("utf-8", "surrogatepass") if r["kind"] == "str" else r["data"]
        if data is None or digest_of(r["kind"], data, tuple(r["shape"] or ()), r["dtype"] or "") != r["digest"]:
            out.append(r["digest"])
    return out


def refs_digest(rows: Iterable[dict]) -> str:
    """Digest of a snapshot's records, as the column form gives it."""
    parts: dict[str, list[str]] = {}
    for r in rows:
        h = hashlib.sha256("|".join([r["kind"], r["col"], r["sample_key"], r["subsample_key"] or "", r["digest"]]).encode()).hexdigest()
        parts.setdefault(h[:4], []).append(h)
    return hashlib.sha256("".join(hashlib.sha256("".join(sorted(p)).encode()).hexdigest() for _, p in sorted(parts.items())).encode()).hexdigest()


def credentials(username: str, password: str) -> str:
    return "Basic " + base64.b64encode(f"{username}:{password}".encode()).decode()
