"""Command line: ``python -m ravelgrid create|fill|scan|contract|accumulate ...`` on stored tensors."""

from __future__ import annotations

import argparse
import sys

from ravelgrid.errors import TensorError, code_of, describe


def main(argv: list[str] | None = None, spark=None) -> int:
    from ravelgrid.engine import TensorEngine

    top = argparse.ArgumentParser(prog="ravelgrid")
    sub = top.add_subparsers(dest="what", required=True)
    p = sub.add_parser("create")
    p.add_argument("path")
    p.add_argument("shape", help="such as 300x300")
    p.add_argument("--dtype", default="fp64")
    p.add_argument("--value", type=complex)
    p = sub.add_parser("fill")
    p.add_argument("path")
    p.add_argument("value", type=complex)
    p = sub.add_parser("scan")
    p.add_argument("path")
    for name in ("contract", "accumulate"):
        p = sub.add_parser(name)
        for arg in ("expr", "a", "b", "c"):
            p.add_argument(arg)
    args = top.parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("ravelgrid").getOrCreate()
    eng = TensorEngine(spark)

    def number(v: complex, dtype: str):
        return v if dtype == "complex128" else v.real

    try:
        if args.what == "create":
            eng.create(args.path, [int(n) for n in args.shape.split("x")], args.dtype)
            if args.value is not None:
                eng.fill(args.path, number(args.value, args.dtype))
        elif args.what == "fill":
            eng.fill(args.path, number(args.value, eng.read(args.path).dtype))
        elif args.what == "scan":
            t = eng.read(args.path)
            print(f"{t.dtype} {'x'.join(map(str, t.shape))}, tiles {'x'.join(map(str, t.chunk))}, {t.df.count()} present")
        else:
            getattr(eng, args.what)(args.expr, args.a, args.b, args.c)
    except TensorError as e:
        print(f"{describe(code_of(e))}: {e}", file=sys.stderr)
        return -code_of(e)
    return 0


if __name__ == "__main__":
    sys.exit(main())
