"""Vector helpers: hashed text embedding, unit vectors and cosine, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom.functions import text as tx

# Dimensions, buckets per word, bucket stride, and norms that count as zero.
DIMENSIONS = 384
BUCKETS = 4
STRIDE = 97
TINY = 1e-9
TINY_TEXT = 1e-7


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once and its expression not copied."""
    return F.transform(F.array(value), use)[0]


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def hash_embedding(text: Column | str) -> Column:
    """Unit vector of a text from its words' digests; all zeros for blank text.

    The first 32 bits of a word's MD5 give its buckets and what it adds to each. Entries are sorted by bucket
    (those of one bucket stay in the order of the words) and added up from the left into a dense array.
    """
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[,.]", " "), f"[{tx.WHITESPACE}]+"), lambda w: w != "")

    def entries(word: Column, place: Column) -> Column:
        return _once(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint"), lambda h: F.array(*[
            F.struct(((h + i * STRIDE) % DIMENSIONS).cast("int").alias("d"), place.alias("w"), F.lit(i).alias("i"),
                     (F.shiftright(h, 4 * i).bitwiseAND(F.lit(255)) / 255.0 - 0.5).alias("x"))
            for i in range(BUCKETS)
        ]))

    # One entry a bucket: the lists stay short, and the dense array is made of them once.
    none = F.array().cast("array<struct<d:int,x:double>>")
    state = F.struct(none.alias("out"), F.lit(-1).alias("d"), F.lit(0.0).alias("x"))

    def close(acc: Column) -> Column:
        return F.concat(acc["out"], F.array(F.struct(acc["d"].alias("d"), acc["x"].alias("x"))))

    def add(acc: Column, e: Column) -> Column:
        closed = F.when(acc["d"] < 0, none).otherwise(close(acc))
        return F.when(e["d"] == acc["d"], F.struct(acc["out"].alias("out"), acc["d"].alias("d"), (acc["x"] + e["x"]).alias("x"))).otherwise(
            F.struct(closed.alias("out"), e["d"].alias("d"), e["x"].alias("x")))

    def dense(filled: Column) -> Column:
        before = lambda i: F.coalesce(F.get(filled, i - 1)["d"], F.lit(-1))
        parts = F.transform(filled, lambda e, i: F.concat(_zeros(e["d"] - before(i) - 1), F.array(e["x"])))
        return F.concat(F.flatten(parts), _zeros(F.lit(DIMENSIONS - 1) - F.element_at(filled, -1)["d"]))

    sums = F.aggregate(F.sort_array(F.flatten(F.transform(words, entries))), state, add, close)
    first = F.concat(F.array(F.lit(1.0)), _zeros(F.lit(DIMENSIONS - 1)))
    scaled = _once(sums, lambda v: _once(_norm(F.transform(v, lambda e: e["x"])), lambda n: F.when(n > TINY_TEXT, _once(
        F.transform(v, lambda e: F.struct(e["d"].alias("d"), (e["x"] / n).alias("x"))), dense)).otherwise(first)))
    # A text of nothing but commas and full stops has no word.
    return F.when(tx.is_blank(text), _zeros(F.lit(DIMENSIONS))).when(F.size(words) == 0, first).otherwise(scaled)


def unit(vector: Column | str) -> Column:
    """A vector scaled to length one; a zero vector stays as it is."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return _once(vector, lambda v: _once(_norm(v), lambda n: F.when(n < TINY, v).otherwise(F.transform(v, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, clamped and rounded to four decimals; 0 when either is a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(dot(a, b) / size, 4)))
    return F.when(size < TINY, 0.0).otherwise(value)
