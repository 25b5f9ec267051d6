"""Property tests: the Spark column functions against small Python models of
the stated rules, on generated names, paths and sizes."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfs.functions import extension_of, is_excluded, size_text
from tallyfs.schema import EXCLUDED_DIRECTORIES

# ASCII plus a few Latin letters: lowercasing agrees across runtimes there.
ALPHABET = st.sampled_from(list("abcXYZ019._- ~") + ["é", "Ü", "ß"])
NAMES = st.text(ALPHABET, min_size=0, max_size=12)
SEGMENT = st.one_of(NAMES.filter(lambda s: "/" not in s and s),
                    st.sampled_from(["Bin", "NODE_MODULES", ".git", "target", "Program Files", "docs", "binx"]))


def model_extension(name: str) -> str:
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def model_excluded(path: str) -> bool:
    return any(p.lower() in EXCLUDED_DIRECTORIES for p in path.split("/")[:-1])


def model_size_text(b: int) -> str:
    if b < 1024:
        return f"{b}B"
    for unit, div in (("KB", 1024), ("MB", 1024 ** 2), ("GB", 1024 ** 3)):
        if unit == "GB" or b < div * 1024:
            v = Decimal(b / float(div)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
            return f"{v} {unit}"


def _col(spark, values, typ, fn):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(NAMES, min_size=1, max_size=200))
def test_extension_matches_model(spark, names):
    assert _col(spark, names, "string", extension_of) == [model_extension(n) for n in names]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(SEGMENT, min_size=1, max_size=6), min_size=1, max_size=200))
def test_excluded_matches_model(spark, parts):
    paths = ["/" + "/".join(p) for p in parts]
    assert _col(spark, paths, "string", is_excluded) == [model_excluded(p) for p in paths]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5000), st.integers(0, 1 << 40),
                          st.sampled_from([1023, 1024, 1152, 1048575, 1048576, 1073741823, 1073741824])),
                min_size=1, max_size=300))
def test_size_text_matches_model(spark, sizes):
    assert _col(spark, sizes, "bigint", size_text) == [model_size_text(b) for b in sizes]
