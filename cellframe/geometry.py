"""Shapes, axis ranges, strides and block arithmetic: no Spark in here."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from .errors import InvalidCoord, InvalidSchema, Unsupported

#: Coordinates are signed 64-bit columns.
LARGEST = 2**63 - 1
#: Values in a batch and in a block at most. Fixed values.
BATCH = 4096


@dataclass(frozen=True)
class At:
    """One index of an axis, which goes away."""

    index: int


@dataclass(frozen=True)
class In:
    """Indices start, start + step, ... below stop."""

    start: int
    stop: int
    step: int = 1


@dataclass(frozen=True)
class Of:
    """Given indices, in their order, repeated ones too."""

    indices: tuple[int, ...]

    def __init__(self, *indices):
        object.__setattr__(self, "indices", tuple(indices[0]) if len(indices) == 1 and isinstance(indices[0], (list, tuple)) else indices)


def check_shape(shape) -> tuple[int, ...]:
    shape = tuple(int(n) for n in shape)
    if not shape or any(n <= 0 for n in shape) or math.prod(shape) > LARGEST:
        raise InvalidSchema(f"shape {shape}: it needs axes, all positive, and fewer than 2**63 cells")
    return shape


def size(shape) -> int:
    return math.prod(shape)


def contiguous_strides(shape) -> tuple[int, ...]:
    out, step = [], 1
    for n in reversed(shape):
        out.append(step)
        step *= n
    return tuple(reversed(out))


def check_coord(shape, coord) -> tuple[int, ...]:
    coord = tuple(int(c) for c in coord)
    if len(coord) != len(shape) or any(not 0 <= c < n for c, n in zip(coord, shape)):
        raise InvalidCoord(f"{coord} in {shape}")
    return coord


def check_axis(shape, axis: int) -> int:
    if not 0 <= axis < len(shape):
        raise InvalidSchema(f"axis {axis} of {len(shape)}")
    return axis


def flat_index(shape, coord) -> int:
    return sum(c * s for c, s in zip(coord, contiguous_strides(shape)))


def coord_of(shape, flat: int) -> tuple[int, ...]:
    return tuple(flat // s % n for s, n in zip(contiguous_strides(shape), shape))


def row_major_coords(shape):
    return product(*map(range, shape))


def check_range(shape, ranges) -> list:
    """One entry for each axis; missing ones at the end select all."""
    ranges = list(ranges)
    if len(ranges) > len(shape):
        raise InvalidSchema(f"{len(ranges)} ranges for {len(shape)} axes")
    ranges += [In(0, n) for n in shape[len(ranges) :]]
    for r, n in zip(ranges, shape):
        if isinstance(r, At) and not 0 <= r.index < n:
            raise InvalidCoord(f"index {r.index} of {n}")
        if isinstance(r, In):
            if r.step <= 0 or r.start < 0 or r.stop > n:
                raise InvalidCoord(f"{r} of {n}")
            if r.start >= r.stop:
                raise InvalidSchema(f"{r} selects nothing")
        if isinstance(r, Of):
            if not r.indices:
                raise InvalidSchema("Of() selects nothing")
            if any(not 0 <= i < n for i in r.indices):
                raise InvalidCoord(f"{r} of {n}")
    return ranges


def broadcast_shape(left, right) -> tuple[int, ...]:
    """The shape that both can be expanded to."""
    n = max(len(left), len(right))
    left, right = (1,) * (n - len(left)) + tuple(left), (1,) * (n - len(right)) + tuple(right)
    if any(a != b and 1 not in (a, b) for a, b in zip(left, right)):
        raise InvalidSchema(f"{left} and {right} have no common shape")
    return tuple(max(a, b) for a, b in zip(left, right))


def reduction_axes(shape, axes) -> list[int]:
    return sorted({check_axis(shape, a) for a in axes})


def reduced_shape(shape, axes, keepdims: bool) -> tuple[int, ...]:
    out = tuple(1 if i in axes else n for i, n in enumerate(shape) if keepdims or i not in axes)
    return out or (1,)


def broadcast_reduce_axes(source, target) -> list[int]:
    """Axes of ``target`` over which to sum to get back ``source``."""
    extra = len(target) - len(source)
    if extra < 0 or broadcast_shape(source, target) != tuple(target):
        raise InvalidSchema(f"{source} does not expand to {target}")
    return [i for i in range(len(target)) if i < extra or (source[i - extra] == 1 and target[i] != 1)]


def matmul_output_shape(left, right) -> tuple[int, ...]:
    if len(left) < 2 or len(right) < 2 or len(left) != len(right):
        raise InvalidSchema(f"matmul of ranks {len(left)} and {len(right)}")
    if left[:-2] != right[:-2]:
        raise InvalidSchema(f"batch axes {left[:-2]} and {right[:-2]}")
    if left[-1] != right[-2]:
        raise InvalidSchema(f"inner axes {left[-1]} and {right[-2]}")
    return tuple(left[:-1]) + (right[-1],)


def matmul_broadcast_shapes(left, right) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Shapes with common batch axes, to expand to before a product."""
    if len(left) < 2 or len(right) < 2:
        raise InvalidSchema(f"matmul of ranks {len(left)} and {len(right)}")
    batch = broadcast_shape(left[:-2] or (1,), right[:-2] or (1,)) if len(left) > 2 or len(right) > 2 else ()
    return batch + tuple(left[-2:]), batch + tuple(right[-2:])


@dataclass(frozen=True)
class StorageGeometry:
    """How cells lie in blocks: dense and fully sparse ones by flat index, sparse ones below an axis by prefix."""

    shape: tuple[int, ...]
    sparse: bool = False
    axis: int | None = None
    max_capacity: int = BATCH

    def __post_init__(self):
        object.__setattr__(self, "shape", check_shape(self.shape))
        if not 1 <= self.max_capacity <= BATCH:
            raise InvalidSchema(f"block capacity {self.max_capacity}")
        if self.axis is not None:
            if not self.sparse:
                raise InvalidSchema("a dense layout has no sparse axis")
            check_axis(self.shape, self.axis)

    @property
    def sparse_axis(self) -> int | None:
        return self.axis

    @property
    def region(self) -> int:
        """Cells that are dense together: all, one, or those of the axes after the sparse one."""
        if not self.sparse:
            return size(self.shape)
        return 1 if self.axis is None else size(self.shape[self.axis + 1 :])

    @property
    def block_capacity(self) -> int:
        return min(self.max_capacity, self.region)

    @property
    def blocks_per_region(self) -> int:
        return -(-self.region // self.block_capacity)

    @property
    def block_count(self) -> int:
        return size(self.shape) // self.region * self.blocks_per_region

    def validate_block(self, block: int) -> int:
        if not 0 <= block < self.block_count:
            raise InvalidCoord(f"block {block} of {self.block_count}")
        return block

    def block_range(self, block: int) -> tuple[int, int]:
        """First flat index and the one after the last."""
        region, part = divmod(self.validate_block(block), self.blocks_per_region)
        start = region * self.region + part * self.block_capacity
        return start, min(start + self.block_capacity, (region + 1) * self.region)

    def block_len(self, block: int) -> int:
        start, stop = self.block_range(block)
        return stop - start

    def block_position(self, coord) -> tuple[int, int]:
        """Block and offset of a coordinate."""
        region, within = divmod(flat_index(self.shape, check_coord(self.shape, coord)), self.region)
        return region * self.blocks_per_region + within // self.block_capacity, within % self.block_capacity


def check_permutation(ndim: int, permutation) -> tuple[int, ...]:
    permutation = tuple(reversed(range(ndim))) if permutation is None else tuple(permutation)
    if sorted(permutation) != list(range(ndim)):
        raise InvalidSchema(f"permutation {permutation} of {ndim} axes")
    return permutation


def check_reshape(shape, strides, target) -> tuple[int, ...]:
    target = check_shape(target)
    if size(target) != size(shape):
        raise InvalidSchema(f"{shape} has not as many cells as {target}")
    if tuple(strides) != contiguous_strides(shape):
        raise Unsupported("reshape of a view that is not contiguous")
    return target
