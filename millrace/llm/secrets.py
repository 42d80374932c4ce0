"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of the letters that keys and tokens are made of, a value that is assigned to a secret's name, a
password inside a URL, or a block with a private key. The forest looks at its length, at how its characters change class,
at how much of it dictionary words cover, and at the path and the words around it. It is trained on labelled findings
(bounded, see LABELLED) and evaluated as nested conditions inside a SQL expression, so scanning and redaction are one pass
over the texts without a shuffle.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import let, text_of

#: A private key; a value after a secret's name, an equals sign or colon, and a quote perhaps; sixteen or more letters,
#: digits and signs of encoded keys; what stands between a user's name and the host of a URL.
CANDIDATE = "|".join((
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]{1,20000}-----END [A-Z ]{0,20}PRIVATE KEY-----",
    r"(?<=[:=]\s{0,2}[\"'`]?)(?<=(?i:passw(?:or)?d|passwd|passphrase|pwd|secret|token|api.?key)[\"']?\s{0,2}[:=]{1,2}\s{0,2}[\"'`]?)[^\s\"'`<>]{8,200}",
    r"[A-Za-z0-9_+/=.\-]{16,}",
    r"(?<=:)(?<=://[^\s/:@]{1,40}:)[^\s/@]{3,64}(?=@)",
))
#: Characters of a candidate's surroundings in which neighbouring words are looked up.
BEFORE, AFTER = 48, 32
MASK = "[SECRET]"
#: Labelled findings that the built-in training set has.
LABELLED = 4000
TREES, DEPTH = 15, 7

#: Words of names, prose and code (fixed values).
DICTIONARY = (
    "the and for with from this that have your here test example sample name user admin data file path image index main page value type list item config default local host server "
    "client service version release build debug info error value number string object class function return import module package system network process memory update delete create "
    "insert select table column query result format language english document content header footer button style script color width height video audio photo search login logout "
    "account address street city country customer order product price total payment company business market report"
).split()
KEY_WORDS = r"(?i)(secret|token|passw|passphrase|api.?key|access.?key|private.?key|auth|bearer|credential|signature|client.?key)[\w\"' \]]{0,12}[:=> (\"']{0,4}\s*[\"'`]?$"
HASH_WORDS = r"(?i)(sha\d*|md5|commit|checksum|digest|hash|revision|etag|integrity|fingerprint|build|uuid|guid|id|ref)[\"' ]{0,2}[:=> (\"'-]{0,4}\s*[\"'`]?$"
PLACEHOLDERS = r"(?i)(example|sample|placeholder|change.?me|your|xxxx|0000|1234567|dummy|redacted|test|[*]{3}|\$[{(]|[{]{2}|environ|getenv|[.]env|\(\)|\[\])"
#: How keys of some issuers begin (fixed values).
PREFIXES = r"^(sk_live_|rk_live_|pk_live_|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|AKIA|ASIA|AIza|npm_|dop_v1_|SG[.])"
FEATURES = ("length", "class_changes", "digits", "capitals", "hex_only", "distinct", "covered", "slashes", "dots", "words_joined", "key_near", "hash_near", "assigned", "quoted", "placeholder", "sample_path", "signs", "prefix", "url_login", "key_block")


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def features(candidate: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of the numbers that the forest looks at."""
    n = F.char_length(candidate)
    words = "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True))
    flag = lambda test: test.cast("int").cast("double")
    values = {
        "length": n.cast("double"),
        "class_changes": _share(_count(candidate, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"), n),
        "digits": _share(_count(candidate, "[0-9]"), n),
        "capitals": _share(_count(candidate, "[A-Z]"), n),
        "hex_only": flag(candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct": _share(F.size(F.array_distinct(F.split(candidate, ""))), F.least(n, F.lit(40))),
        "covered": _share(n - F.char_length(F.regexp_replace(candidate, words, "")), n),
        "slashes": _share(_count(candidate, "/"), n),
        "dots": _share(_count(candidate, r"\."), n),
        "words_joined": _share(_count(candidate, "[_-][a-z]{3,}"), n),
        "key_near": flag(before.rlike(KEY_WORDS)),
        "hash_near": flag(before.rlike(HASH_WORDS)),
        "assigned": flag(before.rlike(r"[:=]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "placeholder": flag(candidate.rlike(PLACEHOLDERS) | candidate.rlike(r"(.)\1{5}")),
        "signs": _share(_count(candidate, "[^A-Za-z0-9]"), n),
        "prefix": flag(candidate.rlike(PREFIXES)),
        "url_login": flag(before.rlike(r"://[^\s/:@]{1,40}:$") & after.startswith("@")),
        "key_block": flag(candidate.startswith("-----BEGIN ")),
        "sample_path": flag(F.coalesce(path, F.lit("")).rlike(r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|docs?|mocks?)([/_.-]|$)")),
    }
    return F.struct(*(values[name].alias(name) for name in FEATURES))


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Made-up findings (candidate, before, after, path, label) of a fixed generator; the same at every call.

    Half are secrets: random hex, base64 or prefixed keys and short passwords where a name of a secret is assigned,
    passwords in URLs, private keys, and keys of known issuers that no name announces. The others are strings of the same
    kinds named as hashes and identifiers, joined words, paths, version names, placeholders, words and references to
    variables that are assigned to a secret's name, and keys in sample files.
    """
    rng = random.Random(11)
    pick = rng.choice
    word = lambda: pick(DICTIONARY)
    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    base = lambda n: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    equals = lambda: pick((' = "', '="', ': "', " = '", "=", ": ", ' := "', ": '"))
    key = lambda: pick((hexes(40), hexes(32), hexes(64), base(43), base(24), pick(("sk_live_", "ghp_", "xoxb-", "AKIA", "pk-")) + base(28)))
    plain_key = lambda: pick((hexes(40), hexes(32), hexes(64), base(43), base(24)))
    sign = lambda: pick("!@#$&?%*")
    short = lambda: pick((word().capitalize() + str(rng.randint(10, 9999)) + sign(), base(8) + sign() + base(3), word() + sign() + word() + str(rng.randint(1, 999)), base(12), hexes(10)))
    lead = lambda: word() + " " + pick(("", "my ", "const ", "export ", "the "))
    named = lambda: lead() + pick(("token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "private_key", "SECRET_KEY", "API_TOKEN", "credential")) + equals()
    password = lambda: lead() + pick(("password", "db_passwd", "pwd", "passphrase", "secret", "PASSWORD", "smtp_password")) + equals()
    digest = lambda: word() + " " + pick(("commit ", "sha256:", 'sha256 = "', "md5 ", "checksum: ", "revision ", 'etag="', 'integrity="sha', "uuid: ", "id=", "build "))
    prose = lambda: word() + " " + word() + pick((" ", ", ", ". ", ": ", " = ", "\n", " (", '"'))
    close = lambda: pick(('"', "'", '" ', "\n", " ")) + word()
    code = lambda: pick(("src/main.py", "config/settings.yaml", "app.js", "deploy.env", ""))
    samples = lambda: pick(("tests/data.py", "docs/example.md", "fixtures/keys.txt"))
    joined = lambda: pick(("_".join(word() for _ in range(4)), "".join(word().capitalize() for _ in range(4)), f"src/{word()}/{word()}/{word()}.py"))
    blank = lambda: pick(("YOUR_API_KEY_HERE_PLEASE", "xxxxxxxxxxxxxxxxxxxxxxxx", "example-token-placeholder", "0000000000000000000000000000", "12345678901234567890", "changeme_changeme_changeme", "================", "--------------------"))
    variable = lambda: pick((f"${{{word().upper()}_TOKEN}}", f"{{{{{word()}.secret}}}}", f"os.environ[{word()}", "process.env.TOKEN", f"get_{word()}()", "************"))
    words = lambda: pick((f"{word()}-{word()}", word() + word(), f"{word()}_or_{word()}", f"{word().capitalize()}.{word()}", "required", "optional", "forgotten", "incorrect", "different", "something"))
    block = lambda: f"-----BEGIN {pick(('RSA ', 'EC ', 'OPENSSH ', ''))}PRIVATE KEY-----\n{base(64)}\n{base(40)}\n-----END PRIVATE KEY-----"
    login = lambda: f"{word()} {pick(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{word()}:"
    issued = lambda: pick(("sk_live_", "ghp_", "xoxb-", "AKIA", "glpat-", "AIza")) + pick((base(24).upper(), base(32)))
    bearer = lambda: lead() + pick(("Authorization: Bearer ", "Bearer ", "bearer "))
    secret = (
        lambda: (key(), named(), close(), code()), lambda: (key(), named(), close(), code()), lambda: (key(), named(), close(), code()), lambda: (short(), password(), close(), code()),
        lambda: (issued(), prose(), close(), code()), lambda: (short(), login(), f"@{word()}.net", code()), lambda: (issued(), login(), f"@{word()}.net", code()), lambda: (block(), prose(), close(), code()),
        lambda: (".".join(base(n) for n in (20, 24, 27)), bearer(), close(), code()),
    )
    uuid = lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    other = (
        lambda: (plain_key(), digest(), close(), code()), lambda: (uuid(), pick((digest, prose))(), close(), code()), lambda: (joined(), prose(), close(), code()), lambda: ("".join(word() for _ in range(4)), prose(), close(), ""),
        lambda: (f"{word()}.{word()}.com.v1.2.3", prose(), close(), ""), lambda: (blank(), pick((named, password, prose))(), close(), code()), lambda: (joined(), named(), close(), code()), lambda: (key(), named(), close(), samples()),
        lambda: (plain_key(), prose(), close(), ""), lambda: (variable(), pick((named, password))(), close(), code()), lambda: (words(), pick((named, password))(), close(), code()),
    )
    made = [(*pick(secret if i % 2 == 0 else other)(), 1.0 - i % 2) for i in range(rows)]
    return spark.createDataFrame(made, "candidate string, before string, after string, path string, label double").coalesce(1)


def train_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list:
    """Trees fitted to labelled findings: nested (feature, threshold, left, right), or a share of secrets at a leaf."""
    rows = labelled.select(features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path")).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInstancesPerNode=2).fit(table)

    def read(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats)
        split = node.split()
        return FEATURES[split.featureIndex()], split.threshold(), read(node.leftChild()), read(node.rightChild())

    return [read(tree._java_obj.rootNode()) for tree in model.trees]


def forest_score(forest: list, f: Column) -> Column:
    """Mean of the trees' leaves, as one expression over a struct of features."""

    def branch(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, left, right = node
        return F.when(f[name] <= threshold, branch(left)).otherwise(branch(right))

    return reduce(lambda a, b: a + b, map(branch, forest)) / len(forest)


def default_forest(spark: SparkSession) -> list:
    return train_forest(labelled_findings(spark))


def scored_candidates(text: Column, path: Column, forest: list) -> Column:
    """array<struct<nth, candidate, score>> of a text's candidates, in order.

    The pieces between candidates are the neighbourhood; they are split off by the same pattern, so that pieces and
    candidates alternate.
    """

    def around(found: Column) -> Column:
        def one(gaps: Column) -> Column:
            def score(c: Column, i: Column) -> Column:
                previous = F.coalesce(F.get(found, i - 1), F.lit(""))
                before = F.concat(F.right(previous, F.lit(BEFORE)), F.right(F.get(gaps, i), F.lit(BEFORE)))
                after = F.left(F.get(gaps, i + 1), F.lit(AFTER))
                value = let(features(c, F.right(before, F.lit(BEFORE)), after, path), lambda f: forest_score(forest, f))
                return F.struct(i.alias("nth"), c.alias("candidate"), value.alias("score"))

            return F.transform(found, score)

        empty = F.array().cast("array<struct<nth:int,candidate:string,score:double>>")
        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, CANDIDATE, -1), one))

    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), around)


def findings(documents: DataFrame, forest: list, threshold: float = 0.5, path: str | None = None) -> DataFrame:
    """One row per candidate of every document: doc_id, nth (of the document's candidates), length, score, is_secret.

    Null and empty texts have no candidates. Repeated rows give their candidates each, null doc_ids too. ``path`` names
    a column with the document's path, if there is one. An empty table gives no rows.
    """
    where = F.col(path) if path else F.lit(None).cast("string")
    rows = documents.select("doc_id", F.explode(scored_candidates(text_of(), where, forest)).alias("f"))
    return rows.select("doc_id", F.col("f.nth").cast("long").alias("nth"), F.char_length("f.candidate").cast("long").alias("length"), "f.score", (F.col("f.score") >= threshold).alias("is_secret"))


def redacted(documents: DataFrame, forest: list, threshold: float = 0.5, text: str = "text", path: str | None = None, mask: str = MASK) -> DataFrame:
    """``documents`` with every secret in the text replaced by the mask; all else stays, null texts too."""
    where = F.col(path) if path else F.lit(None).cast("string")

    def rebuilt(scored: Column) -> Column:
        def join(gaps: Column) -> Column:
            parts = F.transform(scored, lambda s, i: F.concat(F.get(gaps, i), F.when(s["score"] >= threshold, F.lit(mask)).otherwise(s["candidate"])))
            return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))

        any_found = F.exists(scored, lambda s: s["score"] >= threshold)
        return F.when(any_found, let(F.split(F.col(text), CANDIDATE, -1), join)).otherwise(F.col(text))

    return documents.withColumn(text, F.when(F.col(text).isNotNull(), let(scored_candidates(F.col(text), where, forest), rebuilt)))
