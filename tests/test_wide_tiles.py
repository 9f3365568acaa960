import numpy as np
import pandas as pd
import pytest

from lanternway.sources import tilecodec

CELL = tilecodec.cell_of(28.6, 77.2)


def tile(*components):
    k = len(components)
    nodes = pd.DataFrame({"node_id": range(k), "lat": [28.6] * k, "lon": [77.2] * k, "component": components, "halo": [False] * k, "junction": [False] * k})
    edges = pd.DataFrame({"source": [0], "target": [k - 1], "weight": [5], "shape": [[(28.6, 77.2)]], "forward": [True], "reverse": [True]})
    return tilecodec.encode_tile(CELL, nodes, edges)


def test_components_beyond_16_bits(spark):
    """Tiles that 16 bits suffice for stay what they were; the others are of a version of their own and lose nothing."""
    narrow, wide = tile(0, 7, 0xFFFF), tile(0, 7, 0x10000)
    assert narrow[4] == 2 and wide[4] == 3 and len(wide) - len(narrow) == 4  # 6 bytes more, 2 fewer of padding
    for blob, components in ((narrow, [0, 7, 0xFFFF]), (wide, [0, 7, 0x10000]), (tile(300_000, 0x7FFFFFFF), [300_000, 0x7FFFFFFF])):
        cell, nodes, edges = tilecodec.decode_tile(blob)
        assert cell == CELL and nodes["component"].tolist() == components and edges["weight"].tolist() == [5]
    got = tilecodec.decode_tiles(spark.createDataFrame([(bytearray(narrow),), (bytearray(wide),)], "blob binary")).collect()
    assert sorted((r.source_component, r.target_component, r.reverse) for r in got) == [(0, x, b) for x in (0xFFFF, 0x10000) for b in (False, True)]
    for bad in (-1, 0x80000000):
        with pytest.raises(tilecodec.TileError):
            tile(0, bad)
    with pytest.raises(tilecodec.TileError):
        tilecodec.Tile(wide[:4] + (2).to_bytes(4, "little") + wide[8:])
    far = bytearray(wide)
    far[64 + 12 * 3 : 64 + 12 * 3 + 4] = np.array([0x80000000], "<u4").tobytes()
    with pytest.raises(tilecodec.TileError):
        tilecodec.Tile(bytes(far))
