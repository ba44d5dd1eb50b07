"""Pictures as arrays of numbers: perceptual hash, sharpness, histograms and palettes, for many pictures at a time.

Pictures are columns of pixels (row by row; for colours three numbers a pixel) with their width and height. In a batch
those of one size are one array: the cosine transform is a matrix product, the edge filter a sum of shifted arrays,
histograms are counts by number. Nothing is decoded here.

A picture whose pixels don't fit its size, or lie outside 0 to 255, or are null, has null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a side that a picture is brought to for its hash; frequencies taken of each side.
CELLS, LOW = 32, 8
#: Bins of a colour's histogram, and colours of a palette.
BINS, COLOURS = 16, 8


def averaging(n: int, cells: int = CELLS) -> np.ndarray:
    """(cells, n): each cell's share of each of n pixels in a row, so that a product with it brings n pixels to cells."""
    ends = np.linspace(0, n, cells + 1)
    first, last = np.arange(n), np.arange(n) + 1
    return np.maximum(np.minimum(ends[1:, None], last) - np.maximum(ends[:-1, None], first), 0) * (cells / n)


def hashes(grey: np.ndarray) -> np.ndarray:
    """64-bit hashes of grey pictures (n, height, width): which of the low frequencies reach the median of all but the
    first. Pictures of another size than 32 x 32 are averaged to that first."""
    _, h, w = grey.shape
    cells = grey.astype(float) if (h, w) == (CELLS, CELLS) else averaging(h) @ grey.astype(float) @ averaging(w).T
    basis = np.cos((2 * np.arange(CELLS)[None] + 1) * np.arange(LOW)[:, None] * np.pi / (2 * CELLS))
    low = (basis @ cells @ basis.T).reshape(len(grey), LOW * LOW)
    bits = low >= np.median(low[:, 1:], axis=1)[:, None]
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64)


def sharpness(grey: np.ndarray) -> np.ndarray:
    """Variance of the edge filter of each picture: eight times a pixel less its neighbours, cut to 0 to 255; the border is
    as it was."""
    g = grey.astype(np.int32)
    out = g.copy()
    _, h, w = g.shape
    if min(h, w) >= 3:
        around = sum(g[:, 1 + y : h - 1 + y, 1 + x : w - 1 + x] for y in (-1, 0, 1) for x in (-1, 0, 1))
        out[:, 1:-1, 1:-1] = np.clip(9 * g[:, 1:-1, 1:-1] - around, 0, 255)
    return out.reshape(len(g), -1).var(axis=1)


def histograms(colour: np.ndarray) -> np.ndarray:
    """(n, 3, BINS) counts of pictures (n, height, width, 3)."""
    n = len(colour)
    at = (np.arange(n)[:, None, None] * 3 + np.arange(3)) * BINS + colour.reshape(n, -1, 3) // (256 // BINS)
    return np.bincount(at.ravel(), minlength=n * 3 * BINS).reshape(n, 3, BINS)


def palette(colour: np.ndarray, most: int = COLOURS) -> list[tuple[int, int]]:
    """(count, colour as a number) of at most so many colours for one picture's pixels (n, 3), the most frequent first.

    A weighted median cut: the different colours with their counts are one box; the box in which most pixels times its
    widest side lie is cut at the median pixel of that side, until there are enough or none can be cut. A box shows its
    mean.
    """
    code = (colour[:, 0].astype(np.int64) << 16) | (colour[:, 1].astype(np.int64) << 8) | colour[:, 2]
    each, count = np.unique(code, return_counts=True)
    rgb = np.stack([each >> 16, (each >> 8) & 255, each & 255], axis=1)
    boxes = [np.arange(len(each))]
    while len(boxes) < most:
        widths = [rgb[b].max(axis=0) - rgb[b].min(axis=0) for b in boxes]
        weight = [int(w.max()) * int(count[b].sum()) for w, b in zip(widths, boxes, strict=True)]
        k = int(np.argmax(weight))
        if not weight[k]:
            break
        box = boxes.pop(k)
        side = rgb[box, int(widths[k].argmax())]
        order = box[np.argsort(side, kind="stable")]
        values, half = np.sort(side), np.cumsum(count[order]) * 2 >= count[box].sum()
        # equal values of the side stay together, and neither part is empty
        cut = int(np.searchsorted(values, values[int(half.argmax())], side="right"))
        cut = cut if cut < len(order) else int(np.searchsorted(values, values[-1], side="left"))
        boxes[k:k] = [order[:cut], order[cut:]]
    out = []
    for b in boxes:
        mean = (rgb[b] * count[b, None]).sum(axis=0) * 2 + count[b].sum()  # rounded, halves up
        mean = mean // (2 * count[b].sum())
        out.append((int(count[b].sum()), int(mean[0]) << 16 | int(mean[1]) << 8 | int(mean[2])))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _over_sizes(df: DataFrame, keep: list[str], pixels: str, width: str, height: str, depth: int, schema: str, work: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """keep and what work gives for the pictures of each size in a batch; null for those that aren't pictures."""
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{width}`").cast("int").alias("__w"), F.col(f"`{height}`").cast("int").alias("__h"), F.col(f"`{pixels}`").cast("array<int>").alias("__p"))
    whole = F.size("__p") == F.col("__w").cast("long") * F.col("__h") * depth
    good = whole & (F.col("__w") > 0) & (F.col("__h") > 0) & ~F.exists("__p", lambda x: x.isNull() | (x < 0) | (x > 255))
    src = src.withColumn("__p", F.when(good, F.col("__p")))
    names = [*keep, *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, h = (np.nan_to_num(b.column(i).to_numpy(zero_copy_only=False)).astype(np.int64) for i in (-3, -2))
            here = b.column(b.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
            sizes = sorted(set(zip(w[here].tolist(), h[here].tolist(), strict=True)))
            for size in [*sizes, None]:
                rows = np.flatnonzero(~here if size is None else here & (w == size[0]) & (h == size[1]))
                if not len(rows):
                    continue
                own = [b.column(i).take(pa.array(rows)) for i in range(len(keep))]
                if size is None:
                    kinds = work(np.zeros((1, 1, 1, depth), np.uint8) if depth > 1 else np.zeros((1, 1, 1), np.uint8))
                    yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(rows), k.type) for k in kinds]], names)
                    continue
                shape = (len(rows), size[1], size[0], depth) if depth > 1 else (len(rows), size[1], size[0])
                flat = b.column(b.num_columns - 1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*own, *work(flat.astype(np.uint8).reshape(shape))], names)

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{fields}, {schema}")


def grey_features(df: DataFrame, keep: list[str], pixels: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """keep, phash (16 hexadecimal digits), blur and quality of grey pictures."""
    from .media import quality_of

    def work(x: np.ndarray) -> list[pa.Array]:
        return [pa.array([f"{v:016x}" for v in hashes(x).tolist()], pa.string()), pa.array(sharpness(x))]

    return _over_sizes(df, keep, pixels, width, height, 1, "phash string, blur double", work).withColumn("quality", quality_of(F.col("blur")))


def colour_details(df: DataFrame, keep: list[str], pixels: str = "pixels", width: str = "width", height: str = "height", colours: int = COLOURS) -> DataFrame:
    """keep, red, green and blue (histograms of 16 bins), means (of the three colours) and palette (count, colour) of
    pictures with three numbers a pixel."""
    entry = pa.struct([("count", pa.int64()), ("colour", pa.string())])

    def work(x: np.ndarray) -> list[pa.Array]:
        h, flat = histograms(x), x.reshape(len(x), -1, 3)
        shown = [[{"count": n, "colour": f"#{c:06x}"} for n, c in palette(p, colours)] for p in flat]
        return [*[pa.array(h[:, k].tolist(), pa.list_(pa.int64())) for k in range(3)], pa.array(flat.mean(axis=1).tolist(), pa.list_(pa.float64())), pa.array(shown, pa.list_(entry))]

    schema = "red array<bigint>, green array<bigint>, blue array<bigint>, means array<double>, palette array<struct<count:bigint,colour:string>>"
    return _over_sizes(df, keep, pixels, width, height, 3, schema, work)
