"""Messages between groups of documents and buckets of hashes, packed into arrays.

A group asks about hashes; each hash belongs to a bucket, a range of hash values; a bucket sees
what all groups say about its hashes and answers each group.  A message is one row for each pair
of group and bucket, with up to three arrays of equal length as binary columns, so millions of
hashes travel as a few thousand rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FIELDS = [("bucket", pa.int32()), ("grp", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
SCHEMA = pa.schema(FIELDS)
DDL = "bucket int, grp int, kind int, a binary, b binary, c binary"


def bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash: its place in n equal ranges of the 32 highest bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Box:
    """Collects messages for a table of SCHEMA."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def put(self, bucket: int, grp: int, kind: int, *arrays: np.ndarray) -> None:
        body = [np.ascontiguousarray(x).tobytes() for x in arrays]
        self.rows.append((int(bucket), int(grp), kind, *body, *[None] * (3 - len(body))))

    def deal(self, to: np.ndarray, kind: int, *arrays: np.ndarray, grp: int | None = None) -> None:
        """Put the elements of ``arrays`` to the buckets (grp given) or groups (grp None) ``to``."""
        if len(to) == 0:
            return
        order = np.argsort(to, kind="stable")
        to = to[order]
        cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
        arrays = tuple(x[order] for x in arrays)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            key = int(to[i])
            self.put(*((key, grp) if grp is not None else (0, key)), kind, *[x[i:j] for x in arrays])

    def table(self) -> pa.Table:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(FIELDS)
        return pa.table([pa.array(list(c), f[1]) for c, f in zip(columns, FIELDS, strict=True)], schema=SCHEMA)


def low_bytes(x: np.ndarray) -> np.ndarray:
    """The five lowest bytes of each 64-bit number, as rows."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5]


def widened(rows: np.ndarray) -> np.ndarray:
    """Rows of five bytes as 64-bit numbers."""
    out = np.zeros((len(rows), 8), dtype=np.uint8)
    out[:, :5] = rows
    return out.view(np.uint64).ravel()


def unpack(table: pa.Table, kind: int, *types) -> tuple[np.ndarray, ...]:
    """(group of each element, array a, array b, ..) of all messages of a kind.

    A type may be (dtype, width) for an array of rows of fixed width.
    """
    keep = table.filter(pa.array(np.asarray(table.column("kind").to_numpy() == kind, dtype=bool))) if table.num_rows else table
    groups = keep.column("grp").to_numpy().astype(np.int64)
    out, sizes = [], None
    for name, t in zip("abc", types, strict=False):
        dtype, width = t if isinstance(t, tuple) else (t, 1)
        raw = keep.column(name).to_pylist()
        x = np.frombuffer(b"".join(raw), dtype)
        if isinstance(t, tuple):
            x = x.reshape(-1, width)
        if sizes is None:
            each = np.dtype(dtype).itemsize * width
            sizes = np.array([len(r) // each for r in raw], dtype=np.int64)
        out.append(x)
    return (np.repeat(groups, sizes), *out)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in ``sorted_keys``, -1 if it is not there."""
    if len(sorted_keys) == 0:
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
