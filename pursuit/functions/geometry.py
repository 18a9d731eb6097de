"""Column expressions for positions on the field."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pursuit.schema import FIELD_X, FIELD_Y


def is_left():
    return F.col("play_direction") == "left"


def flip(name: str, size: float) -> Column:
    """The coordinate seen from the other end of the field, for plays that run left."""
    return F.when(is_left(), F.lit(size) - F.col(name)).otherwise(F.col(name))


def flip_x(name: str) -> Column:
    return flip(name, FIELD_X)


def flip_y(name: str) -> Column:
    return flip(name, FIELD_Y)


def turn(name: str) -> Column:
    """The angle after half a turn, for plays that run left."""
    return F.when(is_left(), F.pmod(F.col(name) + 180.0, F.lit(360.0))).otherwise(F.col(name))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def velocity() -> tuple[Column, Column]:
    """Speed along x and y: angles are degrees clockwise from the y axis."""
    rad = F.radians("dir")
    return F.col("s") * F.sin(rad), F.col("s") * F.cos(rad)


def to_scrimmage(x: Column, y: Column) -> tuple[Column, Column]:
    """Yards across, from the left as the offense looks downfield, and yards downfield of the line of scrimmage."""
    line = F.col("absolute_yardline_number")
    return (
        F.when(is_left(), y).otherwise(F.lit(FIELD_Y) - y),
        F.when(is_left(), line - x).otherwise(x - line),
    )


def from_scrimmage(across: Column, downfield: Column) -> tuple[Column, Column]:
    line = F.col("absolute_yardline_number")
    return (
        F.when(is_left(), line - downfield).otherwise(line + downfield),
        F.when(is_left(), across).otherwise(F.lit(FIELD_Y) - across),
    )


def clamp_spot(value: Column, size: float) -> Column:
    """A landing coordinate kept within five yards of the field, to a hundredth of a yard."""
    return F.round(F.greatest(F.least(value, F.lit(size + 5.0)), F.lit(-5.0)), 2)


def blend(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def hundredths(value: Column) -> Column:
    """Two decimals, half away from zero, in plain arithmetic; NaN and infinity do not become numbers.

    For frames, of which there are many: the built-in rounding goes through decimal text."""
    y = F.abs(value) * 100.0 + 0.5
    return F.signum(value) * (y - y % 1.0) / 100.0
