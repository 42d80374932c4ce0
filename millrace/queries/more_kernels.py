"""Queries of codecs, automata, rank structures and further row-local kernels."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import codecs as cd
from millrace.functions import kernels as kn
from millrace.functions import kernels_more as km
from millrace.queries import Registry

R = Registry()
CODECS = ", ".join(f"('{c}')" for c in cd.CODECS)


@R.add("codec_round_trip", f"SELECT p_partkey, codec, md5(p_name || ' of ' || p_type) AS digest FROM part, (VALUES {CODECS}) c(codec)")
def _(t):
    data = t.part.select("p_partkey", F.encode(F.concat_ws(" of ", "p_name", "p_type"), "UTF-8").alias("data"))
    columns = [F.struct(F.lit(c).alias("codec"), F.md5(cd.decompress(cd.compress(F.col("data"), c), c)).alias("digest")) for c in cd.CODECS]
    return data.select("p_partkey", F.explode(F.array(*columns)).alias("x")).select("p_partkey", "x.*")


@R.add("palindromic_substrings", "SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey, substr(p_name, i::INT, l::INT) s FROM part, range(1, 30) a(i), range(1, 30) b(l) WHERE i + l - 1 <= length(p_name)) WHERE s = reverse(s) GROUP BY 1")
def _(t):
    return t.part.select("p_partkey", kn.apply(km.palindromic_substrings, T.LongType(), F.col("p_name")).alias("n"))


@R.add("pattern_match", "SELECT p_partkey, regexp_full_match(p_name, '.*l*.g.*') AS hit FROM part")
def _(t):
    return t.part.select("p_partkey", kn.apply(lambda s: km.matches_pattern(s, ".*l*.g.*"), T.BooleanType(), F.col("p_name")).alias("hit"))


def _contains(word: str) -> km.Automaton:
    """Any letters, the word, any letters."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    moves = {(s, c): {s} for s in (0, len(word)) for c in letters}
    for k, c in enumerate(word):
        moves[k, c] = moves.get((k, c), set()) | {k + 1}
    return km.Automaton(moves, 0, {len(word)}).minimize()


@R.add("automaton_match", "SELECT p_partkey, contains(p_name, 'ing') AS hit FROM part")
def _(t):
    machine = _contains("ing")
    return t.part.select("p_partkey", kn.apply(machine.accepts, T.BooleanType(), F.col("p_name")).alias("hit"))


@R.add("perfect_squares", "WITH q AS (SELECT i * i AS q FROM range(1, 8) r(i)) SELECT p_partkey, CASE WHEN p_size IN (SELECT q FROM q) THEN 1 WHEN p_size IN (SELECT a.q + b.q FROM q a, q b) THEN 2 WHEN p_size IN (SELECT a.q + b.q + c.q FROM q a, q b, q c) THEN 3 ELSE 4 END AS n FROM part WHERE p_size > 0")
def _(t):
    return t.part.where("p_size > 0").select("p_partkey", kn.apply(km.perfect_squares, T.IntegerType(), F.col("p_size")).alias("n"))


@R.add("ugly_numbers", "WITH u AS (SELECT row_number() OVER (ORDER BY v) AS n, v FROM (SELECT (2 ** a * 3 ** b * 5 ** c)::BIGINT AS v FROM range(0, 20) x(a), range(0, 13) y(b), range(0, 9) z(c))) SELECT p_partkey, v AS ugly FROM part JOIN u ON n = p_size")
def _(t):
    return t.part.where("p_size > 0").select("p_partkey", kn.apply(km.ugly_number, T.LongType(), F.col("p_size")).alias("ugly"))


@R.add("unique_paths", "SELECT p_partkey, (factorial(p_size::INT + 3) / factorial(p_size::INT - 1) / 24)::BIGINT AS ways FROM part WHERE p_size BETWEEN 1 AND 20 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size NOT BETWEEN 1 AND 20")
def _(t):
    size = F.when(F.col("p_size").between(1, 20), F.col("p_size").cast("int"))
    return t.part.select("p_partkey", kn.apply(lambda n: km.unique_paths(int(n), 5) if n == n else None, T.LongType(), size).alias("ways"))


SIZES = "(SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS place FROM part)"


@R.add("wavelet_rank", f"SELECT p_brand, count(*) FILTER (nth <= 40 AND p_size = 20) AS rank, max(p_size) FILTER (place = 3)::BIGINT AS third FROM {SIZES} GROUP BY 1")
def _(t):
    a = t.part.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda e: e["p_size"]).alias("a"))
    rank = kn.apply(lambda v: km.WaveletTree(v).rank(20, min(40, len(v))), T.LongType(), F.col("a"))
    third = kn.apply(lambda v: km.WaveletTree(v).quantile(2, 0, len(v)) if len(v) > 2 else None, T.LongType(), F.col("a"))
    return a.select("p_brand", rank.alias("rank"), third.alias("third"))
