"""Views that know the tensor they are of and the transforms between."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import geometry as G
from ..errors import InvalidSchema
from ..tensor import Tensor
from . import store


class View:
    """Transforms of ``source``, in order. ``tensor`` is the view as a tensor."""

    def __init__(self, source: Tensor, steps: tuple = ()):
        self.source, self.steps = source, list(steps)
        self.tensor = source
        for name, args in self.steps:
            self.tensor = getattr(self.tensor, name)(*args)

    def with_source(self, source: Tensor) -> "View":
        """The same transforms of another tensor of the shape."""
        if source.shape != self.source.shape:
            raise InvalidSchema(f"a view of {self.source.shape} of a tensor of {source.shape}")
        return View(source, tuple(self.steps))

    def resolve_base_coord(self, coord) -> tuple[int, ...]:
        return store.resolve_base_coord(self.source, self.steps, coord)

    def logical_block_range(self, capacity: int = G.BATCH) -> tuple[int, int]:
        return store.logical_block_range(self.source, self.steps, capacity)

    def plan_updates(self, values, start: int = 0, capacity: int = G.BATCH) -> dict[int, list[tuple]]:
        return store.plan_updates(self.source, self.steps, values, start, capacity)

    def updates_from(self, values: Tensor, capacity: int | None = None) -> DataFrame:
        return store.updates_from(self.source, self.steps, values, capacity)

    def write(self, values: Tensor) -> "View":
        """The view of a tensor with the expression's values in the view's cells."""
        return self.with_source(store.write_from(self.source, self.steps, values))


def _step(name: str):
    def run(self: View, *args) -> View:
        return View(self.source, (*self.steps, (name, args)))

    run.__name__ = name
    return run


for _name in ("slice", "transpose", "reshape", "broadcast", "flip", "squeeze", "unsqueeze"):
    setattr(View, _name, _step(_name))
