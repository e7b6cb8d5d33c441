"""Keys, numbers and labels of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewright.functions.special import finite

MASK64 = (1 << 64) - 1


def row_key(y: Column, s: Column, f: Column, r: Column) -> Column:
    """y1_s2_f3_r4."""
    return F.format_string("y%d_s%d_f%d_r%d", y, s, f, r)


def parse_row_key(key: Column) -> dict[str, Column]:
    """The four numbers of a row key; null where one is missing."""
    return {n: F.regexp_extract(key, rf"(?:^|_){n}([0-9]+)(?:_|$)", 1).try_cast("int") for n in "ysfr"}


def finite_double(text: Column) -> Column:
    """A finite double from text, else null."""
    value = F.trim(text).try_cast("double")
    return F.when(finite(value), value)


def strict_number(text: Column) -> Column:
    """A number written with digits, sign, point and exponent only, else null."""
    return F.when(text.rlike(r"^[0-9eE+.\-]+$"), finite_double(text))


def strict_integer(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def report_number(x: Column) -> Column:
    """One decimal from 100 on, three from 1 on, else six."""
    size = F.abs(x)
    return F.when(size >= 100, F.format_string("%.1f", x)).when(size >= 1, F.format_string("%.3f", x)).otherwise(F.format_string("%.6f", x))


def csv_field(text: Column) -> Column:
    """Quoted only if it holds a comma, quote or line break; inner quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def mix_seed(value: int) -> int:
    """The splitmix64 finaliser: independent random streams from neighbouring numbers."""
    z = (value + 0x9E3779B97F4A7C15) & MASK64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK64
    return z ^ (z >> 31)


def gradient_label(norm: Column) -> Column:
    """PASS below 1e-2, CAUTION below 1e-1, else CHECK; UNKNOWN where not finite."""
    return F.when(~finite(norm), "UNKNOWN").when(norm < 1e-2, "PASS").when(norm < 1e-1, "CAUTION").otherwise("CHECK")


def condition_label(condition: Column) -> Column:
    """EXCELLENT below 100, GOOD below 1,000, CAUTION below 10,000, else HIGH RISK; UNKNOWN where not finite."""
    return F.when(~finite(condition), "UNKNOWN").when(condition < 100, "EXCELLENT").when(condition < 1000, "GOOD").when(condition < 10_000, "CAUTION").otherwise("HIGH RISK")


def model_health(converged: Column, gradient_norm: Column, positive_definite: Column, condition: Column) -> dict[str, Column]:
    """Labels of each check, the optimisation's quality, the overall state and the confidence in it."""
    gradient, conditioning = gradient_label(gradient_norm), condition_label(condition)
    passed = converged & positive_definite & (gradient == "PASS")
    known = finite(gradient_norm) & finite(condition)
    tight = converged & positive_definite & known
    quality = F.when(tight & (gradient_norm < 1e-2) & (condition < 100), "EXCELLENT").when(tight & (gradient_norm < 1e-1) & (condition < 1000), "GOOD").when(converged, "REVIEW").otherwise("CHECK")
    healthy = passed & conditioning.isin("EXCELLENT", "GOOD")
    return {
        "optimization": F.when(converged, "PASS").otherwise("CHECK"),
        "gradient": gradient,
        "curvature": F.when(positive_definite, "PASS").otherwise("CHECK"),
        "conditioning": conditioning,
        "quality": quality,
        "overall": F.when(healthy, "HEALTHY").otherwise("REVIEW"),
        "confidence": F.when(passed & (conditioning == "EXCELLENT"), "HIGH").when(healthy, "MODERATE").otherwise("LOW"),
    }


def uncertainty_structure(average_degree: Column, max_degree: Column, diameter: Column, nodes: Column) -> Column:
    """LOCAL, MODERATE, GLOBAL or MIXED from correlation graph figures; UNKNOWN without degrees."""
    some = finite(nodes) & (nodes > 0)
    return (
        F.when(~(finite(average_degree) & finite(max_degree)), "UNKNOWN")
        .when((average_degree <= 2) & (max_degree <= 3), "LOCAL")
        .when(some & finite(diameter) & (average_degree <= 0.25 * nodes) & (diameter >= 0.25 * nodes), "MODERATE")
        .when(some & (average_degree > 0.5 * nodes), "GLOBAL")
        .otherwise("MIXED")
    )
