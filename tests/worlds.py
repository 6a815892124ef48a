"""Small worlds with a known truth: files of a survey, and where its bodies and deposits are.

Hills are a few long waves. Bodies lie under every crossing of a loose net, each at its own depth; the magnetic field is that
of single poles, gravity that of point masses. Deposits lie over the stronger half of the bodies (buried) or, whatever lies
under them, on the steepest cell of each square of ground."""

import csv
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lodestrata.operators.grid import Meta
from lodestrata.plans import pipeline
from lodestrata.sources import geotiff

CELL, EPSG, EAST, NORTH = 100.0, 32633, 500_000.0, 4_600_000.0


@dataclass(frozen=True)
class World:
    files: dict
    bodies: list
    deposits: list


def table(path, head, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([head, *rows])
    return path


def build(spark, out, seed, n, buried, net=21):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:n, 0:n] * CELL
    dem = np.full((n, n), 900.0)
    for _ in range(12):
        length, turn, shift = rng.uniform(900, 6_000), rng.uniform(0, np.pi), rng.uniform(0, 2 * np.pi)
        dem += 0.02 * length * np.sin(2 * np.pi * (x * np.cos(turn) + y * np.sin(turn)) / length + shift)
    crossings = [(r, c) for r in range(net // 2, n, net) for c in range(net // 2, n, net)]
    bodies, magnetic, gravity = [], rng.normal(0, 0.05, (n, n)), rng.normal(0, 0.02, (n, n))
    for k, (r, c) in enumerate(crossings):
        r, c = (int(np.clip(v + rng.integers(-3, 4), 6, n - 7)) for v in (r, c))
        depth, strength = 400.0 + 40.0 * (k % 12), 60.0 + 5.0 * ((k * 7) % 20)
        d2 = (x - c * CELL) ** 2 + (y - r * CELL) ** 2 + depth**2
        magnetic += strength * depth**3 / d2**1.5
        gravity += 0.2 * strength * depth**2 / d2
        bodies.append((r, c, depth, strength))
    if buried:
        ranked = sorted(bodies, key=lambda b: -b[3])
        deposits = [(b[0], b[1]) for b in ranked[: max(24, len(ranked) // 2)]]
    else:
        steep = np.hypot(*np.gradient(dem, CELL))
        deposits = []
        for r0 in range(8, n - 8, 18):
            for c0 in range(8, n - 8, 18):
                part = steep[r0 : min(r0 + 18, n - 8), c0 : min(c0 + 18, n - 8)]
                r, c = np.unravel_index(part.argmax(), part.shape)
                deposits.append((int(r0 + r), int(c0 + c)))
    files = {}
    meta = Meta(n, n, EAST, NORTH, CELL, -CELL, f"EPSG:{EPSG}")
    pipeline._text(f"{out}/notes.txt", "not a table of points\n")
    for name, values in (("dem", dem), ("magnetics", magnetic), ("gravity", gravity)):
        files[name] = f"{out}/{name}.tif"
        r, c = np.indices((n, n), np.int32)
        cells = spark.createDataFrame(pa.table({"r": r.ravel(), "c": c.ravel(), "v": values.ravel()}))
        geotiff.write(cells, meta, files[name], EPSG)
    centre = lambda r, c: (EAST + (c + 0.5) * CELL, NORTH - (r + 0.5) * CELL)
    files["deposits"] = table(f"{out}/deposits.csv", ("site_name", "longitude", "latitude", "dev_stat", "commod1"), [(f"mine {i}", *centre(r, c), "producer", "Copper") for i, (r, c) in enumerate(deposits)])
    at = rng.integers(4, n - 4, (250, 2)).tolist()
    copper = [round(30 + 500 / (1 + min((r - a) ** 2 + (c - b) ** 2 for a, b in deposits) / 30) + rng.uniform(0, 9), 1) for r, c in at]
    files["geochem_cu"] = table(f"{out}/geochem_cu.csv", ("longitude", "latitude", "cu_ppm"), [(*centre(r, c), v) for (r, c), v in zip(at, copper, strict=True)])
    return World(files, [b[:3] for b in bodies], deposits)


def config(world, **how):
    return pipeline.Config(dem=world.files["dem"], deposits=world.files["deposits"], rasters={k: world.files[k] for k in ("magnetics", "gravity")}, vectors={"geochem_cu": world.files["geochem_cu"]}, max_px=0, **how)
