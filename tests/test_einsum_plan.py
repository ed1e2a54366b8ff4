import pytest

from ravelgrid.errors import EinsumError, TensorDimsError, code_of, describe
from ravelgrid.plans.einsum import check_rank, chunk_shape, chunk_side, parse


@pytest.mark.parametrize(
    "expr, a, b, c",
    [
        ("mk,kn->mn", [0, 1], [0, 1], [0, 1]),
        ("im,jm->ij", [0, 1], [1, 0], [0, 1]),
        ("ijab,akbl->klji", [0, 1, 2, 3], [0, 2, 1, 3], [2, 3, 1, 0]),
        ("abc,cbd->ad", [0, 1, 2], [1, 0, 2], [0, 1]),
        ("ij,jk->ki", [0, 1], [0, 1], [1, 0]),
        ("ij,ij->", [0, 1], [0, 1], []),
    ],
)
def test_permutations(expr, a, b, c):
    plan = parse(expr)
    assert (plan.perm_a, plan.perm_b, plan.perm_c) == (a, b, c)
    assert plan.a in str(plan)


@pytest.mark.parametrize(
    "expr",
    [
        "ij,jk", "ij->ij", "ixj,jk->ik", "ij,jk->ikz", "ij,jk->ikk", "Ij,jk->ik", None, "ii,ij->j", "ij,jj->i", "bij,bjk->bbik", "ij, jk->ik",
        "bij,bjk->bik", "ii->i", "", ",->", "a,b,c->abc", "abcdefghi,a->bcdefghi", "i,ij->jz", 7,
    ],
)
def test_bad_expressions(expr):
    with pytest.raises(EinsumError):
        parse(expr)


def test_batch_labels_on_request():
    assert parse("bij,bjk->bik", allow_batch=True).batch == "b"


def test_shapes():
    plan = parse("ijab,akbl->klji")
    assert plan.shape_of_c((2, 3, 4, 5), (4, 6, 5, 7)) == (6, 7, 3, 2)
    for bad in (((2, 3, 4), (4, 6, 5, 7)), ((2, 3, 4, 5), (4, 6, 6, 7))):
        with pytest.raises(TensorDimsError):
            plan.shape_of_c(*bad)
    for bad in ((), (1,) * 9, (3, 0)):
        with pytest.raises(TensorDimsError):
            check_rank(bad)


@pytest.mark.parametrize(
    "size, element, rank, side",
    [(64 << 10, 8, 2, 91), (256 << 10, 8, 4, 13), (256 << 10, 8, 5, 8), (16 << 10, 8, 3, 13), (2 << 20, 8, 3, 64), (16 << 20, 8, 4, 38), (16 << 20, 8, 5, 18)],
)
def test_chunk_sides(size, element, rank, side):
    assert chunk_side(size, element, rank) == side
    assert chunk_shape((4,) * rank, size, element) == (min(4, side),) * rank


def test_error_codes():
    assert code_of(None) == 0 and code_of(EinsumError()) == -3 and code_of(ValueError()) == -5
    assert describe(-2) == "incompatible dimensions" and describe(-77) == "unknown error"
