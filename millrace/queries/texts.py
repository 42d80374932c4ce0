"""Queries of text, number and geographic functions."""

from pyspark.sql import functions as F

from millrace.functions import maths as mt
from millrace.functions import text as tx
from millrace.queries import Registry
from millrace.queries.statistics import rounded

R = Registry()
NAMES = "FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"


def _pairs(t):
    a, b = (t.nation.select(F.col("n_nationkey").alias(f"k{x}"), F.lower("n_name").alias(x)) for x in "ab")
    return a.join(b, F.col("ka") < F.col("kb"))




@R.add("soundex_codes")
def _(t):
    return t.nation.select("n_nationkey", tx.soundex(F.col("n_name")).alias("code"))


@R.add("levenshtein_pairs", f"SELECT a.n_nationkey AS ka, b.n_nationkey AS kb, levenshtein(lower(a.n_name), lower(b.n_name)) AS d, round(1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)), 8) AS sim {NAMES}")
def _(t):
    return rounded(_pairs(t).select("ka", "kb", tx.edit_distance(F.col("a"), F.col("b")).alias("d"), tx.edit_similarity(F.col("a"), F.col("b")).alias("sim")), sim=8)


@R.add("levenshtein_within", f"SELECT a.n_nationkey AS ka, b.n_nationkey AS kb {NAMES} WHERE levenshtein(lower(a.n_name), lower(b.n_name)) <= 4")
def _(t):
    return _pairs(t).where(tx.within_distance(F.col("a"), F.col("b"), 4)).select("ka", "kb")


@R.add("jaro_winkler", f"SELECT a.n_nationkey AS ka, b.n_nationkey AS kb, round(jaro_similarity(lower(a.n_name), lower(b.n_name)), 6) AS jaro {NAMES}")
def _(t):
    return rounded(_pairs(t).select("ka", "kb", tx.jaro(F.col("a"), F.col("b")).alias("jaro")), jaro=6)


@R.add("string_kernels")
def _(t):
    a, b = F.col("a"), F.col("b")
    return _pairs(t).select("ka", "kb", tx.osa_distance(a, b).alias("osa"), tx.lcs_length(a, b).alias("lcs"), tx.longest_common_substring(a, b).alias("common"), tx.smith_waterman(a, b).alias("local"), tx.needleman_wunsch(a, b).alias("aligned"), F.round(tx.jaro_winkler(a, b), 8).alias("jw"))


@R.add("suffix_kernels")
def _(t):
    s = F.lower("p_name")
    return t.part.select("p_partkey", tx.longest_repeat(s).alias("repeat"), tx.distinct_substrings(s).alias("substrings"), tx.longest_palindrome(s).alias("palindrome"))


@R.add("lzw_round_trip", "SELECT p_partkey, p_name AS back FROM part")
def _(t):
    return t.part.select("p_partkey", tx.lzw_decode(tx.lzw_encode(F.col("p_name"))).alias("back"))


@R.add("glob_match", "SELECT page_id, regexp_full_match(url, '.*[0-4]') AS hit FROM pages")
def _(t):
    return t.pages.select("page_id", tx.glob_match(F.col("url"), "*[0-4]").alias("hit"))


@R.add("substr_positions", "SELECT p_partkey, [i - 1 for i in range(1, length(p_name) + 1) if substr(p_name, i, 1) = 'e'] AS places FROM part")
def _(t):
    return t.part.select("p_partkey", tx.positions(F.col("p_name"), "e").cast("array<bigint>").alias("places"))


@R.add("multi_pattern_count", "SELECT w AS pattern, count(*) AS docs FROM documents, (VALUES ('the '), ('tion'), ('token'), ('und')) v(w) WHERE contains(text, w) GROUP BY 1")
def _(t):
    found = [F.when(F.contains(F.col("text"), F.lit(w)), F.lit(w)) for w in ("the ", "tion", "token", "und")]
    return t.documents.select(F.explode(F.array_compact(F.array(*found))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("docs"))


@R.add("anagram_groups", "SELECT array_to_string(list_sort(string_split(lower(c_mktsegment), '')), '') AS letters, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy(tx.canonical(F.lower("c_mktsegment")).alias("letters")).agg(F.count("*").alias("n"))


@R.add("rle_text", "SELECT o_orderpriority, o_orderpriority AS back FROM (SELECT DISTINCT translate(o_orderpriority, '0123456789', '') AS o_orderpriority FROM orders)")
def _(t):
    s = t.orders.select(F.translate("o_orderpriority", "0123456789", "").alias("o_orderpriority")).distinct()
    return s.withColumn("back", tx.run_length_decode(tx.run_length_encode(F.col("o_orderpriority"))))


@R.add("lcp_of_set", "SELECT p_brand, max(p) AS lcp FROM (SELECT p_brand, substr(min(p_name), 1, n) p FROM part, range(0, 40) t(n) GROUP BY p_brand, n HAVING substr(min(p_name), 1, n) = substr(max(p_name), 1, n)) GROUP BY 1")
def _(t):
    g = t.part.groupBy("p_brand").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"))
    return g.select("p_brand", tx.common_prefix(F.col("lo"), F.col("hi")).alias("lcp"))


@R.add("prefix_count", "SELECT substr(c_name, 1, 14) AS prefix, count(*) AS n FROM customer WHERE starts_with(c_name, 'Customer#') GROUP BY 1")
def _(t):
    return t.customer.where(F.startswith(F.col("c_name"), F.lit("Customer#"))).groupBy(F.substring("c_name", 1, 14).alias("prefix")).agg(F.count("*").alias("n"))


@R.add("dna_functions", "SELECT p_partkey, reverse(translate(d, 'ACGT', 'TGCA')) AS rc, round(length(translate(d, 'AT', '')) / length(d), 8) AS gc FROM (SELECT p_partkey, translate(substr(md5(p_name), 1, 24), '0123456789abcdef', 'ACGTACGTACGTACGT') d FROM part)")
def _(t):
    d = t.part.select("p_partkey", F.translate(F.substring(F.md5("p_name"), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT").alias("d"))
    return rounded(d.select("p_partkey", tx.reverse_complement(F.col("d")).alias("rc"), tx.gc_content(F.col("d")).alias("gc")), gc=8)


@R.add("bit_functions", "SELECT o_orderkey, bit_count(o_orderkey) AS ones, bit_count(xor(o_orderkey, o_custkey)) AS hamming, bit_count(o_orderkey) % 2 AS parity, xor(o_orderkey, o_orderkey >> 1) AS gray, o_orderkey AS back, (o_orderkey > 0 AND bit_count(o_orderkey) = 1) AS pow2 FROM orders")
def _(t):
    x = F.col("o_orderkey")
    return t.orders.select("o_orderkey", mt.popcount(x).alias("ones"), mt.hamming_distance(x, F.col("o_custkey")).alias("hamming"), mt.parity(x).alias("parity"), mt.gray(x).alias("gray"), mt.ungray(mt.gray(x)).alias("back"), mt.is_power_of_two(x).alias("pow2"))


@R.add("gcd_lcm", "SELECT o_orderkey, gcd(o_orderkey, o_custkey) AS g, lcm(o_orderkey, o_custkey) AS l FROM orders WHERE o_orderkey > 0 AND o_custkey > 0")
def _(t):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.where("o_orderkey > 0 and o_custkey > 0").select("o_orderkey", mt.gcd(a, b).alias("g"), mt.lcm(a, b).alias("l"))


@R.add("primes", "SELECT n AS prime FROM range(2, 2001) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) d(d) WHERE n % d = 0 AND n != d)")
def _(t):
    return mt.primes_up_to(t.spark, 2000)


@R.add("number_kernels")
def _(t):
    n = F.col("p_partkey")
    return t.part.where("p_partkey > 0").select("p_partkey", mt.is_prime(n).alias("prime"), mt.totient(n).alias("phi"), mt.factors(n).alias("factors"), mt.modpow(F.lit(3), n, F.lit(1000007)).alias("power"))


LL = "(SELECT c_custkey, c_nationkey, (c_custkey * 37 % 180) - 90.0 AS lat, (c_custkey * 101 % 360) - 180.0 AS lon FROM customer)"


def _places(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", ((k * 37) % 180 - 90.0).alias("lat"), ((k * 101) % 360 - 180.0).alias("lon"))


@R.add("haversine", f"SELECT c_custkey, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - least(h, 1))), 4) AS km FROM (SELECT c_custkey, sin(radians(lat - 48.0) / 2) ** 2 + cos(radians(48.0)) * cos(radians(lat)) * sin(radians(lon - 11.0) / 2) ** 2 AS h FROM {LL})")
def _(t):
    return rounded(_places(t).select("c_custkey", mt.haversine(F.lit(48.0), F.lit(11.0), F.col("lat"), F.col("lon")).alias("km")), km=4)


@R.add("bearing", f"SELECT c_custkey, round((degrees(atan2(sin(radians(lon - 11.0)) * cos(radians(lat)), cos(radians(48.0)) * sin(radians(lat)) - sin(radians(48.0)) * cos(radians(lat)) * cos(radians(lon - 11.0)))) + 360) % 360, 6) AS deg FROM {LL}")
def _(t):
    return rounded(_places(t).select("c_custkey", mt.bearing(F.lit(48.0), F.lit(11.0), F.col("lat"), F.col("lon")).alias("deg")), deg=6)


@R.add("geohash")
def _(t):
    return _places(t).select("c_custkey", mt.geohash(F.col("lat"), F.col("lon"), 7).alias("hash"))
