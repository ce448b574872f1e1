"""Pitch geometry on percentage coordinates: metres, distance and opening angle to goal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .semantics import col


def x_metres(c: str | Column, length: float = K.PITCH_LENGTH_M) -> Column:
    return col(c).cast("double") / F.lit(100.0) * F.lit(length)


def y_metres(c: str | Column, width: float = K.PITCH_WIDTH_M) -> Column:
    return col(c).cast("double") / F.lit(100.0) * F.lit(width)


def distance_to_goal(x_m: Column, y_m: Column, length: float = K.PITCH_LENGTH_M,
                     width: float = K.PITCH_WIDTH_M) -> Column:
    """Euclidean distance in metres from (x_m, y_m) to the centre of the goal line."""
    dx = F.lit(length) - x_m
    dy = F.lit(width / 2) - y_m
    return F.sqrt(dx * dx + dy * dy)


def goal_angle_deg(x_m: Column, y_m: Column, length: float = K.PITCH_LENGTH_M,
                   width: float = K.PITCH_WIDTH_M, goal_width: float = K.GOAL_WIDTH_M) -> Column:
    """Angle (degrees) between the lines from the shot to the two posts, folded to <= 180."""
    left_post = F.lit(width / 2 - goal_width / 2)
    right_post = F.lit(width / 2 + goal_width / 2)
    a1 = F.atan2(left_post - y_m, F.lit(length) - x_m)
    a2 = F.atan2(right_post - y_m, F.lit(length) - x_m)
    ang = F.abs(a2 - a1)
    ang = F.when(ang > F.pi(), F.lit(2.0) * F.pi() - ang).otherwise(ang)
    return ang * F.lit(180.0) / F.pi()


def is_finite(c: Column) -> Column:
    """``is.finite``: not null, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
