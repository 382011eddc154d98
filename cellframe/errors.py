"""Errors of tensor construction and evaluation, raised while a plan is built."""


class TensorError(Exception):
    """Base of all errors of this package."""


class InvalidSchema(TensorError):
    """A shape, axis or dtype that does not fit."""


class InvalidCoord(TensorError):
    """A coordinate outside the shape."""


class InvalidLayout(TensorError):
    """A dense tensor where a sparse one is needed, or the reverse."""


class SparseIndex(TensorError):
    """Sparse elements that are out of order or occur twice."""


class UnsupportedSparseIterationOrder(TensorError):
    """Sparse elements asked for in another order than row-major."""


class WouldDensify(TensorError):
    """An operation that would turn absent zeros into other values."""


class Unsupported(TensorError):
    """A request that the tensor's mapping or dtype does not allow."""


class DataMismatch(TensorError):
    """More or fewer values than cells."""
