from pyspark.sql import functions as F

from tessera.functions import files, identity, text, vectors
from tessera.sources.rules import ALLOW, IGNORE, Ignore, extensions_of, lines_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_locked_identity(spark):
    assert one(spark, identity.point_id(F.lit("docs"), F.lit("guide/intro.md"), F.lit("a" * 64), F.lit(0))) == "490a9819-a5f9-53fc-8c44-ebb1b84b3d79"
    assert identity.index_of("hello") == 1785136887
    assert identity.index_of("world") == 13193140
    got = spark.createDataFrame([("hello",), (None,)], "t string").select(identity.term_index("t").alias("i")).collect()
    assert [r["i"] for r in got] == [1785136887, None]


def test_estimate_tokens(spark):
    want = {"hello world foo": 5, "a b c d e f g h i j": 10, "": 0, "one two three four five": 7, "a b\x1cc": 3}
    for t, n in want.items():
        assert one(spark, text.estimate_tokens(F.lit(t))) == n


def test_terms(spark):
    assert one(spark, text.terms(F.lit("Foo, bar. foo-bar (foo) Éa_1"))) == ["foo", "bar", "foo", "bar", "foo", "éa_1"]
    assert one(spark, text.terms(F.lit("!!!"))) == []


def test_decode(spark):
    data = b"a\r\nb\rc\xff"
    assert one(spark, text.decode(F.lit(bytearray(data)))) == data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def test_cosine(spark):
    c = lambda a, b: one(spark, vectors.cosine(vectors.literal(a), vectors.literal(b)))
    assert c([1, 0], [1, 0]) == 1 and c([1, 0], [0, 1]) == 0 and c([0, 0], [1, 1]) == 0


def test_files(spark):
    ext = lambda p: one(spark, files.extension(F.lit(p)))
    assert [ext(p) for p in ("a/b.MD", ".env", "x", "a.tar.gz", "d.x/y")] == [".md", "", "", ".gz", ""]
    kinds = [one(spark, files.classify(F.lit(e))) for e in (".pdf", ".PY", ".xyz", "")]
    assert kinds == ["known_binary", "known_text", "other", "other"]
    reason = lambda kind, size, data: one(spark, files.skip_reason(F.lit(kind), F.lit(size), F.lit(None if data is None else bytearray(data)).cast("binary"), 100, 10))
    assert reason("known_text", 101, b"a") == "too_large:101>100"
    assert reason("known_text", 100, b"a") is None
    assert reason("other", 11, b"\0") == "too_large:11>10"
    assert reason("other", 9, b"a\0") == "binary"
    assert reason("other", 9, None) == "binary"
    assert reason("known_binary", 9999, b"\0") is None


def test_rules():
    assert len(ALLOW) == len(set(ALLOW)) and all(e.startswith(".") for e in ALLOW)
    ig = Ignore([*IGNORE, "*.log", "drop.md", "!.github/", "/top.txt", "a/**/z", "x[0-9]?"])
    yes = ["a.log", "d/a.log", "drop.md", "top.txt", "a/z", "a/b/c/z", "x1y", ".env", ".env.local", "k.pem", "node_modules/p.js", ".git/config", "section.yaml"]
    no = ["a.md", "d/top.txt", "xay", ".github/w.yml", "_index.md", ".editorconfig", "envy"]
    assert [p for p in yes if not ig.matches(p)] == [] and [p for p in no if ig.matches(p)] == []
    assert ig.matches("build", directory=True) and not ig.matches("build")
    assert extensions_of("# c\nlog\n.ZZZ\n\n") == {".log", ".zzz"}
    assert lines_of(" a \n#b\n\n") == ["a"]
