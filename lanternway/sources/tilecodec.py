"""Binary route tiles: one byte string per cell, for exchange with readers of that format.

Little endian: a header of 64 bytes, node columns (lat, lon f32; id u32; component u16; flags u8; padding to 4),
forward and reverse adjacency (offsets, far slot, weight, shape reference; u32 each), then shapes (u16 count, f32
pairs). A shape reference's high bit says that the shape is read backwards.

Version 2 is that format. A tile with a component that 16 bits don't hold is version 3, which differs in one thing: its
components are u32. Readers of version 2 alone refuse such a tile by its version instead of reading it wrongly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.functions.geo import HEURISTIC_MPS
from lanternway.operators.nearby import haversine

#: Fixed values of the format.
MAGIC, VERSION, WIDE_VERSION, HEADER_BYTES = 0x4F475254, 2, 3, 64
HALO, JUNCTION, BACKWARDS = 1, 2, 0x80000000
MOST_COMPONENT = 0x7FFFFFFF
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


class TileError(ValueError):
    """A tile that breaks a rule of the format."""


def cell_box(cell: str) -> tuple[float, float, float, float]:
    """(south, west, north, east) of a geohash."""
    low, high = [-180.0, -90.0], [180.0, 90.0]
    for k, bit in enumerate((ALPHABET.index(ch) >> (4 - b)) & 1 for ch in cell for b in range(5)):
        axis = k % 2
        middle = (low[axis] + high[axis]) / 2
        (low if bit else high)[axis] = middle
    return low[1], low[0], high[1], high[0]


def _component_kind(version: int) -> str:
    return "<u4" if version == WIDE_VERSION else "<u2"


def encode_tile(cell: str, nodes: pd.DataFrame, edges: pd.DataFrame) -> bytes:
    """nodes: node_id, lat, lon, component, halo, junction. edges: source, target, weight, shape (list of (lat, lon)), forward, reverse."""
    if len(cell) != 6 or any(ch not in ALPHABET for ch in cell):
        raise TileError(f"not a cell of six characters: {cell!r}")
    nodes = nodes.sort_values("node_id")
    ids = nodes["node_id"].to_numpy(np.int64)
    if len(ids) and (ids[0] < 0 or ids[-1] > 0xFFFFFFFF or (np.diff(ids) <= 0).any()):
        raise TileError("node ids must be distinct and fit 32 bits")
    if ((nodes["component"] < 0) | (nodes["component"] > MOST_COMPONENT)).any():
        raise TileError("component exceeds 31 bits")
    version = WIDE_VERSION if (nodes["component"] > 0xFFFF).any() else VERSION
    if ((edges["weight"] < 1) | (edges["weight"] > 0xFFFFFFFF)).any():
        raise TileError("weight out of range")
    flags = nodes["halo"].to_numpy(bool) * HALO + nodes["junction"].to_numpy(bool) * JUNCTION
    columns = nodes["lat"].to_numpy("<f4").tobytes() + nodes["lon"].to_numpy("<f4").tobytes() + ids.astype("<u4").tobytes() + nodes["component"].to_numpy(_component_kind(version)).tobytes() + flags.astype("u1").tobytes()
    columns += b"\0" * (-(HEADER_BYTES + len(columns)) % 4)
    pool, places = bytearray(), {}

    source, target, weight = (edges[c].to_numpy(np.int64) for c in ("source", "target", "weight"))
    shapes = list(edges["shape"])

    def shape_at(k: int, backwards: bool) -> int:
        a, b = int(source[k]), int(target[k])
        up = a <= b
        points = np.asarray(shapes[k], "<f4").reshape(-1, 2)
        raw = (points if up else points[::-1]).tobytes()
        key = (min(a, b), max(a, b), raw)
        if key not in places:
            places[key] = len(pool)
            pool.extend(struct.pack("<H", len(points)) + raw)
        return places[key] | (0 if up != backwards else BACKWARDS)

    def adjacency(used: np.ndarray, near: np.ndarray, far: np.ndarray, backwards: bool) -> tuple[bytes, int]:
        order = np.flatnonzero(used)
        order = order[np.lexsort((weight[order], far[order], near[order]))]
        slot = np.searchsorted(ids, near[order])
        offsets = np.searchsorted(slot, np.arange(len(ids) + 1))
        refs = np.array([shape_at(k, backwards) for k in order], "<u4")
        return offsets.astype("<u4").tobytes() + np.searchsorted(ids, far[order]).astype("<u4").tobytes() + weight[order].astype("<u4").tobytes() + refs.tobytes(), len(order)

    ahead, n_ahead = adjacency(edges["forward"].to_numpy(bool), source, target, False)
    back, n_back = adjacency(edges["reverse"].to_numpy(bool), target, source, True)
    body = columns + ahead + back
    low, high = (int.from_bytes(cell[k : k + 3].encode(), "little") for k in (0, 3))
    south, west, north, east = cell_box(cell)
    head = struct.pack("<9I4f", MAGIC, version, len(ids), n_ahead, n_back, low, high, HEADER_BYTES + len(body), len(pool), south, west, north, east)
    return head.ljust(HEADER_BYTES, b"\0") + body + bytes(pool)


def cell_of(lat: float, lon: float) -> str:
    """The cell of six characters a place is in; a place on a middle line belongs to the lower half."""
    low, high, out, value = [-180.0, -90.0], [180.0, 90.0], "", 0
    for k in range(30):
        axis = k % 2
        middle = (low[axis] + high[axis]) / 2
        up = (lon, lat)[axis] > middle
        (low if up else high)[axis] = middle
        value = value * 2 + up
        if k % 5 == 4:
            out, value = out + ALPHABET[value], 0
    return out


class Tile:
    """A tile's columns and adjacency as views of its bytes; TileError if it is not sound.

    lists: forward and reverse (offsets, far slot, weight, shape reference).
    """

    def __init__(self, blob: bytes):
        self.blob = blob
        if len(blob) < HEADER_BYTES:
            raise TileError("shorter than a header")
        magic, version, n, n_ahead, n_back, low, high, self.at_pool, n_pool = struct.unpack_from("<9I", blob)
        box = struct.unpack_from("<4f", blob, 36)
        if magic != MAGIC or version not in (VERSION, WIDE_VERSION):
            raise TileError("not a tile of a known version")
        self.cell = (low.to_bytes(4, "little")[:3] + high.to_bytes(4, "little")[:3]).decode("latin-1")
        if any(ch not in ALPHABET for ch in self.cell):
            raise TileError("bad cell")
        if not (np.isfinite(box).all() and -90 <= box[0] < box[2] <= 90 and -180 <= box[1] < box[3] <= 180):
            raise TileError("bad box")
        parts = _component_kind(version)
        end = HEADER_BYTES + (13 + int(parts[-1])) * n
        at = end + (-end) % 4
        if at + 8 * (n + 1) + 12 * (n_ahead + n_back) != self.at_pool or self.at_pool + n_pool != len(blob):
            raise TileError("sizes do not add up")
        place = HEADER_BYTES

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(blob, kind, count, place)
            place += out.nbytes
            return out

        self.lat, self.lon, self.ids, self.component, self.flags = take("<f4", n), take("<f4", n), take("<u4", n), take(parts, n), take("u1", n)
        place = at
        self.lists = [(take("<u4", n + 1), take("<u4", k), take("<u4", k), take("<u4", k)) for k in (n_ahead, n_back)]
        self.halo = (self.flags & HALO) > 0
        self._check(n)

    def _check(self, n: int) -> None:
        if not (np.isfinite(self.lat).all() and np.isfinite(self.lon).all()):
            raise TileError("position not finite")
        if n > 1 and (np.diff(self.ids.astype(np.int64)) <= 0).any():
            raise TileError("ids not ascending")
        if (self.flags & ~np.uint8(HALO | JUNCTION)).any():
            raise TileError("unknown flag")
        if (self.component > MOST_COMPONENT).any():
            raise TileError("component exceeds 31 bits")
        for offsets, far, weight, refs in self.lists:
            o = offsets.astype(np.int64)
            if o[0] != 0 or o[-1] != len(far) or (np.diff(o) < 0).any():
                raise TileError("adjacency offsets")
            if (far >= n).any() or (weight < 1).any() or (np.diff(o)[self.halo] > 0).any():
                raise TileError("adjacency entries")
            for ref in np.unique(refs).tolist():
                self.shape(ref)
            near = np.repeat(np.arange(n), np.diff(o))
            metres = haversine(self.lat[near].astype(float), self.lon[near].astype(float), self.lat[far].astype(float), self.lon[far].astype(float))
            if (weight < np.floor(metres / HEURISTIC_MPS * 100)).any():
                raise TileError("weight below what the distance allows")

    def shape(self, ref: int) -> list[tuple[float, float]]:
        o = self.at_pool + (ref & ~BACKWARDS)
        if o + 2 > len(self.blob):
            raise TileError("shape reference")
        (k,) = struct.unpack_from("<H", self.blob, o)
        if o + 2 + 8 * k > len(self.blob):
            raise TileError("shape cut off")
        points = np.frombuffer(self.blob, "<f4", 2 * k, o + 2)
        if not np.isfinite(points).all():
            raise TileError("shape not finite")
        points = points.reshape(-1, 2).astype(float).tolist()
        return [tuple(p) for p in (points[::-1] if ref & BACKWARDS else points)]

    def nodes(self) -> pd.DataFrame:
        return pd.DataFrame({"node_id": self.ids.astype(np.int64), "lat": self.lat.astype(float), "lon": self.lon.astype(float), "component": self.component.astype(np.int32), "halo": self.halo, "junction": (self.flags & JUNCTION) > 0})

    def edges(self, backwards: bool = False) -> pd.DataFrame:
        """source, target, weight, shape of one adjacency; a shape runs from source to target either way."""
        offsets, far, weight, refs = self.lists[1 if backwards else 0]
        near, other = np.repeat(self.ids, np.diff(offsets.astype(np.int64))).astype(np.int64), self.ids[far].astype(np.int64)
        source, target = (other, near) if backwards else (near, other)
        shapes = [self.shape(r) for r in refs.tolist()]
        return pd.DataFrame({"source": source, "target": target, "weight": weight.astype(np.int64), "shape": [s[::-1] for s in shapes] if backwards else shapes})


def decode_tile(blob: bytes) -> tuple[str, pd.DataFrame, pd.DataFrame]:
    """(cell, nodes, edges) of a tile; edges are the forward ones with their shapes. Raises TileError if it is not sound."""
    tile = Tile(blob)
    return tile.cell, tile.nodes(), tile.edges()


def encode_tiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cell, blob of each tile. nodes: cell, node_id (dense), lat, lon, component, halo, junction; edges: cell, source,
    target (dense), weight, shape ARRAY<STRUCT<lat, lon>>, forward, reverse. What a cell holds is bounded
    by its size on the ground, so it is gathered as one row."""

    ns = nodes.groupBy("cell").agg(F.collect_list(F.struct("node_id", "lat", "lon", "component", "halo", "junction")).alias("n"))
    es = edges.groupBy("cell").agg(F.collect_list(F.struct("source", "target", "weight", "shape", "forward", "reverse")).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blobs = []
            for cell, n, e in zip(pdf["cell"], pdf["n"], pdf["e"]):
                e = [dict(x, shape=[(p["lat"], p["lon"]) for p in x["shape"]] if x["shape"] is not None else []) for x in (e if e is not None else [])]
                ef = pd.DataFrame(e, columns=["source", "target", "weight", "shape", "forward", "reverse"]).astype({"forward": bool, "reverse": bool})
                blobs.append(encode_tile(cell, pd.DataFrame(list(n)), ef))
            yield pd.DataFrame({"cell": pdf["cell"], "blob": blobs})

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A number of its own, as the sizes alone would merge all cells into one Python task.
    return ns.join(es, "cell", "left").repartition(n, F.crc32("cell")).mapInPandas(run, "cell string, blob binary")


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """Both adjacencies of tiles (column blob, as binaryFile or encode_tiles give them): cell, reverse, source, target, weight,
    n_shape, the sums of the shape's coordinates along the edge, each times its place, and the components of both ends."""
    schema = "cell string, reverse boolean, source long, target long, weight long, n_shape int, lat_sum double, lon_sum double, source_component int, target_component int"

    columns = [c.split()[0] for c in schema.split(", ")]

    def of_tile(tile: Tile) -> Iterator[tuple]:
        """The columns of each adjacency of a tile."""
        sums: dict[int, tuple[int, float, float]] = {}
        for backwards, (offsets, far, weight, refs) in enumerate(tile.lists):
            if not len(far):
                continue
            near = np.repeat(np.arange(len(tile.ids)), np.diff(offsets.astype(np.int64)))
            source, target = (far, near) if backwards else (near, far)
            # A reference of the reverse list says how the shape runs against the edge.
            along = (refs ^ np.uint32(BACKWARDS) if backwards else refs).tolist()
            for ref in along:
                if ref not in sums:
                    points = np.array(tile.shape(ref)).reshape(-1, 2)
                    sums[ref] = (len(points), *(np.arange(1, len(points) + 1) @ points).tolist())
            n, lat, lon = zip(*(sums[r] for r in along))
            size = len(far)
            yield (
                np.full(size, tile.cell), np.full(size, bool(backwards)), tile.ids[source].astype(np.int64), tile.ids[target].astype(np.int64), weight.astype(np.int64), np.array(n, np.int32),
                np.array(lat), np.array(lon), tile.component[source].astype(np.int32), tile.component[target].astype(np.int32),
            )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [part for blob in pdf["blob"] for part in of_tile(Tile(bytes(blob)))]
            if parts:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(columns, zip(*parts))})

    return tiles.select(F.col("blob")).mapInPandas(run, schema)
