"""Scalar functions: rotations, seeds, splits, text."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wrapped_angle(x: Column) -> Column:
    """An angle brought into [-pi, pi) if it is outside."""
    import math

    return F.when((x >= -math.pi) & (x < math.pi), x).otherwise(x - 2 * math.pi * F.floor((x + math.pi) / (2 * math.pi)))


def quaternion_axis_angle(q: Column) -> Column:
    """Axis times angle of an (x, y, z, w) quaternion; zero near the identity."""
    w = F.least(F.greatest(q[3], F.lit(-1.0)), F.lit(1.0))
    length = F.sqrt(1 - w * w)
    return F.when(length < 1e-8, F.array(*[F.lit(0.0)] * 3)).otherwise(F.transform(F.slice(q, 1, 3), lambda x: x * 2 * F.acos(w) / length))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rotation_quaternion(turn: Column, kind: str = "vector") -> Column:
    """The unit (w, x, y, z) quaternion of a rotation vector, or of ``euler`` angles about the fixed x, y and z axes in turn."""
    if kind == "vector":
        angle = F.sqrt(turn[0] * turn[0] + turn[1] * turn[1] + turn[2] * turn[2])
        scale = F.when(angle == 0, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
        return F.array(F.cos(angle / 2), turn[0] * scale, turn[1] * scale, turn[2] * scale)
    if kind != "euler":
        raise ValueError("kind must be vector or euler")
    half = lambda k: (F.array(F.cos(turn[k] / 2), *[F.sin(turn[k] / 2) if j == k else F.lit(0.0) for j in range(3)]))
    return let(quaternion_product(half(1), half(0)), lambda q: quaternion_product(half(2), q))


def quaternion_product(a: Column, b: Column) -> Column:
    """The rotation b followed by a, both (w, x, y, z)."""
    w, x, y, z = 0, 1, 2, 3
    return F.array(
        a[w] * b[w] - a[x] * b[x] - a[y] * b[y] - a[z] * b[z], a[w] * b[x] + a[x] * b[w] + a[y] * b[z] - a[z] * b[y],
        a[w] * b[y] - a[x] * b[z] + a[y] * b[w] + a[z] * b[x], a[w] * b[z] + a[x] * b[y] - a[y] * b[x] + a[z] * b[w])


def quaternion_angle(a: Column, b: Column) -> Column:
    """The rotation angle between two unit quaternions, from their sum's and difference's lengths (the sign of either doesn't matter)."""
    length = lambda f: F.sqrt(F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x * x))
    apart, along = length(lambda x, y: x - y), length(lambda x, y: x + y)
    return 4 * F.atan2(F.least(apart, along), F.greatest(apart, along))


def quaternion_rotation_vector(q: Column) -> Column:
    """Axis times angle (0 to pi) of a unit (w, x, y, z) quaternion."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    length = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    angle = 2 * F.atan2(length, sign * q[0])
    return F.array(*[F.when(angle < 1e-7, 0.0).otherwise(sign * q[k] * angle / length) for k in (1, 2, 3)])


def quaternion_euler(q: Column) -> Column:
    """Angles about the fixed x, y and z axes of a unit (w, x, y, z) quaternion; upright (90 degrees about y) the last is 0."""
    w, x, y, z = (q[k] for k in range(4))
    pitch = F.asin(F.least(F.greatest(2 * (w * y - x * z), F.lit(-1.0)), F.lit(1.0)))
    upright = F.abs(F.cos(pitch)) <= 1e-7
    roll = F.when(upright, F.atan2(2 * (x * w - y * z), 1 - 2 * (x * x + z * z))).otherwise(F.atan2(2 * (y * z + w * x), 1 - 2 * (x * x + y * y)))
    return F.array(roll, pitch, F.when(upright, 0.0).otherwise(F.atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z))))


def euler_trace_angle(turn: Column) -> Column:
    """The angle (0 to pi) of a turn by ``euler`` angles, from the trace of its matrix; less exact than ``quaternion_rotation_vector`` at either end."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(turn[k]), F.sin(turn[k])) for k in range(3))
    return F.acos(F.least(F.greatest((cz * cy + sz * sy * sx + cz * cx + cy * cx - 1) / 2, F.lit(-1.0)), F.lit(1.0)))


def environment_action(action: Column, threshold: float = 0.5) -> Column:
    """Seven numbers for the simulator: the move, the turn from Euler angles to a rotation vector, and the gripper as +1 (beyond the threshold) or -1."""
    turn = let(rotation_quaternion(F.slice(action, 4, 3), "euler"), quaternion_rotation_vector)
    return F.concat(F.slice(action, 1, 3), turn, F.array(F.when(F.get(action, F.lit(6)) > threshold, 1.0).otherwise(-1.0)))


def demo_gripper(x: Column) -> Column:
    """A gripper command from 1 (shut) to -1 (open), as an opening between 0 and 1."""
    return F.least(F.greatest((1 - x) / 2, F.lit(0.0)), F.lit(1.0))


def number_tag(x: float) -> str:
    """A number as a part of a path: twelve digits at most, ``p`` for the point."""
    return format(float(x), ".12g").replace(".", "p")


def instruction(task: Column, episode_tasks: Column, fallback: str) -> Column:
    """The first that is not blank of the task table's text, the episode's own, and a fallback."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(task), F.get(F.filter(F.transform(episode_tasks, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(fallback))


def instruction_from_name(name: Column) -> Column:
    """Words of a file name: what stands before the scene's number and the ``_demo`` suffix go, underscores become spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(_demo)?(\.hdf5)?$", ""), r"^.*SCENE\d+_", ""), "_", " ")))


@F.pandas_udf(T.BooleanType())
def is_validation(seed: pd.Series, episode: pd.Series, percent: pd.Series) -> pd.Series:
    """A stable split: eight bytes of blake2b of ``seed:episode``, mod 100, below the percentage."""
    draw = [int.from_bytes(hashlib.blake2b(f"{s}:{e}".encode(), digest_size=8).digest(), "big") % 100 for s, e in zip(seed, episode, strict=True)]
    return pd.Series(draw) < percent.reset_index(drop=True)
