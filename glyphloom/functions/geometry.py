"""Boxes, angles and affine maps as column expressions. A box is four columns with a common prefix: x0, y0, x1, y1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x0", "y0", "x1", "y1")


def corners(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in CORNERS)


def area(prefix: str = "") -> Column:
    x0, y0, x1, y1 = corners(prefix)
    return F.greatest(x1 - x0, F.lit(0)) * F.greatest(y1 - y0, F.lit(0))


def intersection(a: str, b: str) -> Column:
    """The common area of two boxes; 0 where they only touch."""
    ax0, ay0, ax1, ay1 = corners(a)
    bx0, by0, bx1, by1 = corners(b)
    return F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0)) * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0))


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 for two boxes without area."""
    common = intersection(a, b)
    return common / F.greatest(area(a) + area(b) - common, F.lit(1e-12))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def wrapped(angle: Column, turn: float = 360.0) -> Column:
    """An angle in [-turn / 2, turn / 2)."""
    return F.pmod(angle + turn / 2, F.lit(turn)) - turn / 2


def transform(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 2 x 3 matrix, an array of two rows."""
    return tuple(matrix[i][0] * x + matrix[i][1] * y + matrix[i][2] for i in range(2))


def compose(a: Column, b: Column) -> Column:
    """The 2 x 3 matrix that first applies b, then a."""
    return F.array(*(F.array(a[i][0] * b[0][0] + a[i][1] * b[1][0], a[i][0] * b[0][1] + a[i][1] * b[1][1], a[i][0] * b[0][2] + a[i][1] * b[1][2] + a[i][2]) for i in range(2)))


def quarter_inverse(quarter: Column, width: Column, height: Column) -> Column:
    """Maps a page turned clockwise by a quarter (0, 90, 180, 270) back to the page as it was, of this width and height."""
    row = lambda *v: F.array(*(F.lit(x).cast("double") if not isinstance(x, Column) else x.cast("double") for x in v))
    return (
        F.when(quarter == 90, F.array(row(0, 1, 0), row(-1, 0, height)))
        .when(quarter == 180, F.array(row(-1, 0, width), row(0, -1, height)))
        .when(quarter == 270, F.array(row(0, -1, width), row(1, 0, 0)))
        .otherwise(F.array(row(1, 0, 0), row(0, 1, 0)))
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def matrix3(*rows: tuple) -> Column:
    """A 3 x 3 matrix of columns and numbers, as an array of three rows."""
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.array(*(F.array(*map(number, row)) for row in rows))


def product3(a: Column, b: Column) -> Column:
    """The 3 x 3 matrix that first applies b, then a."""
    rows = lambda a, b: F.array(*(F.array(*(a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3))) for i in range(3)))
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda m: rows(m["a"], m["b"]))


def inverse3(m: Column) -> Column:
    """The inverse of a 3 x 3 matrix by its minors; null where there is none."""

    def minor(m: Column, i: int, j: int) -> Column:
        (a, b), (c, d) = (tuple(k for k in range(3) if k != n) for n in (i, j))
        value = m[a][c] * m[b][d] - m[a][d] * m[b][c]
        return value if (i + j) % 2 == 0 else -value

    def inverse(m: Column) -> Column:
        whole = m[0][0] * minor(m, 0, 0) + m[0][1] * minor(m, 0, 1) + m[0][2] * minor(m, 0, 2)
        return F.when(whole != 0, bound(whole, lambda w: F.array(*(F.array(*(minor(m, j, i) / w for j in range(3))) for i in range(3)))))

    return bound(m, inverse)


def projected(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 matrix."""
    u, v, w = (m[i][0] * x + m[i][1] * y + m[i][2] for i in range(3))
    return u / w, v / w


def turn3(angle: Column, cx: Column, cy: Column) -> Column:
    """A turn by degrees, against the clock on a page whose y grows downwards, about a point."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return matrix3((c, s, (1 - c) * cx - s * cy), (-s, c, s * cx + (1 - c) * cy), (0, 0, 1))


def shift3(x: Column, y: Column) -> Column:
    return matrix3((1, 0, x), (0, 1, y), (0, 0, 1))


def turned_page(width: Column, height: Column, angle: Column) -> tuple[Column, Column, Column]:
    """How a page is turned about its middle onto a canvas that holds it all: the matrix, and the canvas's width and height."""
    c, s = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    w, h = F.ceil(c * width + s * height), F.ceil(s * width + c * height)
    return product3(shift3((w - width) / 2, (h - height) / 2), turn3(angle, width / 2, height / 2)), w, h


def straightened(width: Column, height: Column, angle: Column, crop_x: Column, crop_y: Column) -> Column:
    """What a page goes through when it is straightened: padded so that the turned page fits (not if it is square), turned about the
    middle, padded to the page's aspect, and cropped by crop_x and crop_y. Its `inverse3` leads back to the page."""
    c, s = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    grows = width != height
    more = lambda n, turned: F.when(grows, F.greatest(F.ceil(turned - n), F.lit(0))).otherwise(F.lit(0)).cast("long")
    wp, hp = more(width, c * width + s * height), more(height, s * width + c * height)
    pw, ph = width + wp, height + hp
    high = ph / pw > height / width
    other = grows & (ph / pw != height / width)
    wp2 = F.when(other & high, (ph * width / height - pw).cast("long")).otherwise(0)
    hp2 = F.when(other & ~high, (pw * height / width - ph).cast("long")).otherwise(0)
    half = lambda n: F.floor(n / 2)
    path = product3(turn3(angle, pw / 2, ph / 2), shift3(half(wp), half(hp)))
    return product3(shift3(-crop_x, -crop_y), product3(shift3(half(wp2), half(hp2)), path))
