"""Scalar expressions: names and paths, hashes, statistics of vectors, geometry. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of derived files, and tokens that mark derivatives.
AUGMENTATIONS = "brightness|noise|gaussian|hsv|gamma"
DERIVATIVE_TOKENS = "aug|augment|brightness|bright|noise|gauss|resiz(?:e|ed)|640|480|369|277|404|303"
#: Confidence tiers from weak to strong.
TIERS = ("Unresolved", "Candidate", "Supported", "Strongly Supported", "Confirmed")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def family(name: Column) -> Column:
    """Stem without a terminal augmentation suffix, lower case."""
    return F.lower(source_stem(name))


def source_stem(name: Column) -> Column:
    return F.regexp_replace(stem(name), f"(?i)_({AUGMENTATIONS})$", "")


def augmentation_type(name: Column) -> Column:
    found = F.lower(F.regexp_extract(stem(name), f"(?i)_({AUGMENTATIONS})$", 1))
    return F.when(found == "", "none").otherwise(found)


def bare_stem(name: Column) -> Column:
    """Derivative tokens anywhere become one underscore, in a single pass; outer separators go."""
    replaced = F.regexp_replace(stem(name), rf"(?i)(?:^|[_\-.])({DERIVATIVE_TOKENS})(?:$|[_\-.])", "_")
    return F.lower(F.regexp_replace(replaced, r"^[_.\-]+|[_.\-]+$", ""))


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def reference(split: Column, name: Column) -> Column:
    return F.concat_ws("/", split, name)


def hash_order(split: Column, name: Column) -> Column:
    return F.sha2(F.concat_ws(":", split, name), 256)


def derived_seed(hex_digest: Column, context: str) -> Column:
    """First 8 bytes, big-endian, of SHA-256 over the digest's bytes and a context, as decimal text (unsigned)."""
    return F.conv(F.substring(F.sha2(F.concat(F.unhex(hex_digest), F.lit(context).cast("binary")), 256), 1, 16), 16, 10)


def tier_rank(tier: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in enumerate(TIERS):
        out = F.when(tier == name, rank).otherwise(out)
    return out


def hamming(a: Column, b: Column, limbs: int) -> Column:
    """Differing bits of two arrays of ``limbs`` 64-bit integers."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(limbs)), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; different or zero lengths give null, zero variance 1 for equal arrays, else 0."""
    n = F.size(a)
    sa, sb = total(a), total(b)
    product = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    va = total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))) * n - sa * sa
    vb = total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))) * n - sb * sb
    flat = F.when(a == b, 1.0).otherwise(0.0)
    value = F.when((va == 0) | (vb == 0), flat).otherwise((product * n - sa * sb) / F.sqrt(va * vb))
    return F.when((n == F.size(b)) & (n > 0), value)


def moments(values: Column) -> Column:
    """(n, sum, squares) of an array of integers: what ``pearson_of`` needs of one side."""
    add = lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["sum"] + x).alias("sum"), (s["squares"] + x * x).alias("squares"))
    zero = F.lit(0).cast("long")
    return F.aggregate(values, F.struct(zero.alias("n"), zero.alias("sum"), zero.alias("squares")), add)


def pearson_of(a: Column, b: Column, ma: Column, mb: Column) -> Column:
    """``pearson`` of two arrays of integers whose moments are known: one pass over the pair, exact up to the root."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    spread = lambda m: m["squares"] * m["n"] - m["sum"] * m["sum"]
    over = dot * ma["n"] - ma["sum"] * mb["sum"]
    root = F.sqrt(spread(ma).cast("double") * spread(mb).cast("double"))
    value = F.when(root == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(over / root)
    return F.when((ma["n"] == mb["n"]) & (ma["n"] > 0), value)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [left, top, right, bottom]; 0 if the union is empty."""
    at = lambda box, k: F.get(box, F.lit(k))
    wide = F.greatest(F.lit(0.0), F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)))
    high = F.greatest(F.lit(0.0), F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)))
    area = lambda box: F.greatest(F.lit(0.0), at(box, 2) - at(box, 0)) * F.greatest(F.lit(0.0), at(box, 3) - at(box, 1))
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def bounds(xs: Column, ys: Column) -> Column:
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def twice_area(xs: Column, ys: Column) -> Column:
    """Shoelace sum, absolute; null or fewer than three points give 0."""
    n = F.size(xs)
    corner = lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i)
    total_ = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + corner(i))
    return F.when(n >= 3, F.abs(total_)).otherwise(0.0)


def optimizer_iterations(images: Column, batch: Column, nominal: Column, epochs: Column) -> Column:
    """Projected optimizer steps: batches of at least the nominal size, for every epoch."""
    return (F.ceil(images / F.greatest(batch, nominal)) * epochs).cast("long")
