import pytest
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions.glob import compiled, excluded, matches


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("", 0), ("hello world", 3), ("x" * 401, 101), ("return value;" + "가" * 5, 9), (None, None), ("😀" * 4, 2)])
def test_tokens(spark, text, want):
    assert one(spark, T.approx_tokens(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("word,stem", [
    ("secrets", "secret"), ("scanning", "scan"), ("scans", "scan"), ("queries", "query"), ("applied", "apply"), ("detected", "detect"), ("detecting", "detect"), ("stopped", "stop"),
    ("classes", "class"), ("cases", "case"), ("boxes", "box"), ("gas", "gas"), ("is", "is"), ("string", "string"), ("during", "during"), ("something", "something"), ("installed", "install"),
    ("class", "class"), ("status", "status"), ("seed", "seed"), ("hundred", "hundred"), ("anschließens", "anschließen")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.lit(word))) == stem


def test_search_tokens(spark):
    got = one(spark, T.search_tokens(F.lit("The XMLParser reads_queries, 색인값 A 値; fooBar2Baz")))
    assert got == ["xml", "parser", "read", "query", "색인", "인값", "値", "foo", "bar2", "baz"]
    assert one(spark, T.search_tokens(F.lit(""))) == []


def test_words_keep_underscores_and_part_at_accents(spark):
    assert one(spark, T.words(F.lit("Étre tre a_b-c"))) == ["tre", "tre", "a_b", "c"]


def test_count_substring(spark):
    assert one(spark, T.count_substring(F.lit("aAaA b"), "aa")) == 2
    with pytest.raises(ValueError):
        T.count_substring(F.lit("x"), "")


def test_paths(spark):
    assert one(spark, F.array(*[T.extension(F.lit(p)) for p in ("a/b.ts", ".x", "a/.x", "a.b/c", "a.tar.gz")])) == [".ts", "", "", "", ".gz"]
    assert one(spark, F.array(*[T.is_test_path(F.lit(p)) for p in ("tests/a.py", "a/test_b.py", "a.spec.tsx", "contest.py", "a/conftest.py")])) == [True, True, True, False, True]


@pytest.mark.parametrize("glob,yes,no", [
    ("src/**", ["src/a", "src/a/b", "src"], ["srcs/a", "a/src/b"]), ("**/*.py", ["a.py", "x/y/a.py"], ["a.pyc"]), ("*.ts", ["a.ts", ".ts"], ["x/a.ts"]), ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]),
    ("{a,b}/?.c", ["a/x.c", "b/y.c"], ["c/x.c", "a/xy.c"]), ("[!a]b", ["cb"], ["ab"]), ("gen", ["gen"], ["gen/x"])])
def test_globs(spark, glob, yes, no):
    r = compiled(glob)
    assert all(r.match(p) for p in yes) and not any(r.match(p) for p in no)
    rows = spark.createDataFrame([(p,) for p in [*yes, *no]], "p string").filter(matches(F.col("p"), [glob])).collect()
    assert {r.p for r in rows} == set(yes)


def test_an_excluded_folder_excludes_what_it_holds(spark):
    rows = spark.createDataFrame([("gen/a/b.py",), ("src/gen.py",)], "p string").filter(excluded(F.col("p"), ["gen"])).collect()
    assert [r.p for r in rows] == ["gen/a/b.py"]
