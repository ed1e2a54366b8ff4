"""What can go wrong, by kind."""


class TensorError(Exception):
    """Any error of this library."""


class TensorFileError(TensorError):
    """A tensor that is missing, unreadable or already there."""


class TensorDimsError(TensorError):
    """Shapes, ranks or tile sizes that do not fit together."""


class EinsumError(TensorError):
    """A malformed or unsupported expression."""


class TensorTypeError(TensorError):
    """Element types that do not match or are not supported."""


#: Numeric codes for callers that want them.
CODES = {TensorFileError: -1, TensorDimsError: -2, EinsumError: -3, MemoryError: -4}


def code_of(error: BaseException | None) -> int:
    """0 for none, else the code of the error's kind (-5: any other)."""
    if error is None:
        return 0
    return next((c for kind, c in CODES.items() if isinstance(error, kind)), -5)


def describe(code: int) -> str:
    """Text for a code."""
    names = {0: "ok", -1: "file error", -2: "incompatible dimensions", -3: "bad expression", -4: "out of memory", -5: "internal error"}
    return names.get(code, "unknown error")
