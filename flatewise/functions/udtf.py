"""Table functions for SQL: `SELECT * FROM deflate_blocks(payload)` and `deflate_tokens(payload)`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from flatewise.operators import inflate


class Blocks:
    """One row for each block of a raw stream."""

    def eval(self, payload: bytes):
        for b in inflate.parse(bytes(payload or b""), keep_output=False).blocks:
            yield b.index, b.kind, b.final, b.bits, b.out_size, b.literals, b.matches


class TokenRows:
    """One row for each token: literals have their byte and no distance, matches a length and a distance."""

    def eval(self, payload: bytes):
        for b in inflate.parse(bytes(payload or b""), keep_tokens=True, keep_output=False).blocks:
            for i, (a, distance) in enumerate(b.tokens or ()):
                yield (b.index, i, a, None, None) if distance < 0 else (b.index, i, None, a, distance)


def register(spark: SparkSession) -> None:
    spark.udtf.register("deflate_blocks", udtf(Blocks, returnType="index int, kind int, final int, bits long, out_size long, literals long, matches long"))
    spark.udtf.register("deflate_tokens", udtf(TokenRows, returnType="block int, position int, literal int, length int, distance int"))
