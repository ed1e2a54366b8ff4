"""Two-operand Einstein summation: from the expression to a checked plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from ravelgrid.errors import EinsumError, TensorDimsError

MAX_RANK = 8


@dataclass(frozen=True)
class EinsumPlan:
    """Labels of A, B and C, and what each label does."""

    a: str
    b: str
    c: str
    batch: str = ""

    @property
    def contracted(self) -> str:
        return "".join(x for x in self.a if x in self.b and x not in self.c)

    @property
    def free_a(self) -> str:
        return "".join(x for x in self.a if x not in self.b)

    @property
    def free_b(self) -> str:
        return "".join(x for x in self.b if x not in self.a)

    @property
    def perm_a(self) -> list[int]:
        """Axes of A as (free, contracted)."""
        return [self.a.index(x) for x in self.free_a + self.contracted]

    @property
    def perm_b(self) -> list[int]:
        """Axes of B as (contracted, free)."""
        return [self.b.index(x) for x in self.contracted + self.free_b]

    @property
    def perm_c(self) -> list[int]:
        """For each axis of C its place in (free of A, free of B)."""
        return [(self.free_a + self.free_b).index(x) for x in self.c]

    def shape_of_c(self, shape_a: Sequence[int], shape_b: Sequence[int]) -> tuple[int, ...]:
        """The shape of C; raises where A and B do not fit the labels or one another."""
        for name, labels, shape in (("A", self.a, shape_a), ("B", self.b, shape_b)):
            if len(labels) != len(shape):
                raise TensorDimsError(f"{name} has rank {len(shape)}, the expression says {len(labels)}")
        size = dict(zip(self.a, shape_a))
        for x, n in zip(self.b, shape_b):
            if size.setdefault(x, n) != n:
                raise TensorDimsError(f"label {x!r}: {size[x]} in A and {n} in B")
        return tuple(size[x] for x in self.c)

    def __str__(self) -> str:
        say = lambda s: s or "-"
        return (
            f"{self.a},{self.b}->{self.c}: free A {say(self.free_a)}, free B {say(self.free_b)}, "
            f"contracted {say(self.contracted)}" + (f", batch {self.batch}" if self.batch else "")
        )


def parse(expr: str, allow_batch: bool = False) -> EinsumPlan:
    """``"ab,bc->ac"`` to a plan.

    Labels are a to z, each at most once per operand.  Every label of A or B is
    in the other operand (contracted), or in C (free); with ``allow_batch`` it
    may be in all three.  A scalar result (nothing after the arrow) is allowed.
    """
    if not isinstance(expr, str):
        raise EinsumError("the expression is not a string")
    left, arrow, c = expr.partition("->")
    a, comma, b = left.partition(",")
    if not arrow or not comma:
        raise EinsumError(f"{expr!r} is not of the form 'ab,bc->ac'")
    for name, labels in (("A", a), ("B", b), ("C", c)):
        if any(not "a" <= x <= "z" for x in labels):
            raise EinsumError(f"{name}: labels are a to z, got {labels!r}")
        if len(set(labels)) != len(labels):
            raise EinsumError(f"{name}: a label is repeated in {labels!r}")
        if len(labels) > MAX_RANK or (not labels and name != "C"):
            raise EinsumError(f"{name}: 1 to {MAX_RANK} labels, got {len(labels)}")
    lost = [x for x in a + b if x not in c and not (x in a and x in b)]
    if lost:
        raise EinsumError(f"label {lost[0]!r} is neither contracted nor in the result")
    if extra := [x for x in c if x not in a + b]:
        raise EinsumError(f"label {extra[0]!r} of the result is in no operand")
    batch = "".join(x for x in a if x in b and x in c)
    if batch and not allow_batch:
        raise EinsumError(f"label {batch[0]!r} is in A, B and C; pass allow_batch=True for batched products")
    return EinsumPlan(a, b, c, batch)


def check_rank(shape: Sequence[int]) -> tuple[int, ...]:
    """A shape that can be stored: 1 to 8 dims, none empty."""
    shape = tuple(int(n) for n in shape)
    if not 1 <= len(shape) <= MAX_RANK:
        raise TensorDimsError(f"rank {len(shape)} is not within 1 to {MAX_RANK}")
    if any(n < 1 for n in shape):
        raise TensorDimsError(f"shape {shape} has an empty dimension")
    return shape


def chunk_side(target_bytes: int, element_bytes: int, rank: int) -> int:
    """Side of a near-cubic tile of about ``target_bytes`` (rounded up to whole 16 KiB)."""
    page = 16 << 10
    elements = max(1, -(-max(1, target_bytes) // page)) * page / element_bytes
    return max(1, int(elements ** (1.0 / rank) + 0.5))


def chunk_shape(shape: Sequence[int], target_bytes: int, element_bytes: int) -> tuple[int, ...]:
    side = chunk_side(target_bytes, element_bytes, len(shape))
    return tuple(min(side, n) for n in shape)


def label_sizes(plan: EinsumPlan, shape_a: Sequence[int], shape_b: Sequence[int]) -> Mapping[str, int]:
    return dict(zip(plan.a, shape_a)) | dict(zip(plan.b, shape_b))
