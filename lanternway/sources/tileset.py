"""Loaded route tiles as one graph: tiles come and go one by one, and nodes of the halo say which tile is wanted next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lanternway.sources.tilecodec import Tile, TileError


class TileSet:
    """Tiles by cell, with the owner of every node.

    A node is owned by the one tile that holds it as its own; other tiles may hold a copy in their halo, which
    has its place but no arcs. Two owners of a node are an error, and nothing is added then.
    """

    def __init__(self) -> None:
        self._tiles: dict[str, Tile] = {}
        self._owner: dict[int, str] = {}
        self._copies: dict[int, set[str]] = {}

    def __len__(self) -> int:
        return len(self._tiles)

    def __contains__(self, cell: str) -> bool:
        return cell in self._tiles

    @property
    def loaded(self) -> list[str]:
        return list(self._tiles)

    @property
    def capacity(self) -> int:
        """Nodes of all tiles, copies included."""
        return sum(len(t.ids) for t in self._tiles.values())

    def add(self, tile: Tile) -> None:
        if self._tiles.get(tile.cell) is tile:
            return
        if tile.cell in self._tiles:
            raise TileError(f"{tile.cell} is loaded; remove it first")
        own = tile.ids[~tile.halo].tolist()
        if taken := [n for n in own if n in self._owner]:
            raise TileError(f"node {taken[0]} has an owner already; the tiles are not of one build")
        self._tiles[tile.cell] = tile
        self._owner.update(dict.fromkeys(own, tile.cell))
        for n in tile.ids[tile.halo].tolist():
            self._copies.setdefault(n, set()).add(tile.cell)

    def remove(self, cell: str) -> None:
        if (tile := self._tiles.pop(cell, None)) is None:
            return
        for n in tile.ids[~tile.halo].tolist():
            self._owner.pop(n, None)
        for n in tile.ids[tile.halo].tolist():
            self._copies[n].discard(cell)

    def clear(self) -> None:
        self.__init__()

    def resolve(self, node: int) -> tuple[Tile, int, bool] | None:
        """(tile, place in it, whether it is a copy): the owner, else any copy in a halo."""
        cell = self._owner.get(node) or next(iter(sorted(self._copies.get(node, ()))), None)
        if cell is None:
            return None
        tile = self._tiles[cell]
        return tile, int(np.searchsorted(tile.ids, node)), node not in self._owner

    def position(self, node: int) -> tuple[float, float] | None:
        if (found := self.resolve(node)) is None:
            return None
        tile, k, _ = found
        return float(tile.lat[k]), float(tile.lon[k])

    def component(self, node: int) -> int:
        found = self.resolve(node)
        return int(found[0].component[found[1]]) if found else -1

    def owner_missing(self, node: int) -> str | None:
        """The cell that owns a node of which only copies are loaded; None for others."""
        from lanternway.sources.tilecodec import cell_of

        if node in self._owner or (at := self.position(node)) is None:
            return None
        return cell_of(*at)

    def arcs(self, node: int, backwards: bool) -> Iterator[tuple[int, int]]:
        """(node at the other end, weight) of what leaves a node, or enters it; nothing where its tile is not loaded."""
        if node not in self._owner:
            return
        tile, k, _ = self.resolve(node)
        offsets, far, weight, _ = tile.lists[1 if backwards else 0]
        for i in range(int(offsets[k]), int(offsets[k + 1])):
            yield int(tile.ids[far[i]]), int(weight[i])
