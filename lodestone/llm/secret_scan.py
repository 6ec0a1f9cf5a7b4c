"""Operator 10: secret scan with a random forest, in DataFrame functions only.

Candidates are found in the whole text, each with its place: runs of at least
12 key-like characters that hold a digit or begin like a known kind of key,
and whatever stands where an asking name (password, token, ...) is given a
value. Features: length, transitions between kinds of characters, share that a
dictionary covers, signs of a path, and neighbouring words. The forest is
trained on labelled findings by the JVM's library and then written out as one
column expression, so that scoring is plain SQL inside the row: no shuffle, no
Python, and memory of one document. Secrets are blanked at their places only,
and no secret is in the result but as a place.

The dictionary is the corpus's own vocabulary: the `WORDS` words of letters
found in most documents, counted over the whole of every text.

Labelled findings are a table (value, before, after, label). Where the caller
has none, `example_findings` makes `EXAMPLES` of them from hashes: values of
many alphabets and lengths in many settings, labelled by what they are, and
`corpus_findings` adds all candidates of the corpus whose kind is beyond
doubt (published key formats; numbers, digests that are named as such).

Nulls and ties: a null text is an empty text; each row is judged alone, so
repeated rows, null ids and empty tables need no care; a value that occurs
twice in a text is two findings, each judged at its own place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, sealed, table

_ASKING = r"(?:passw(?:or)?d|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key)"
_NAMING = r"(?i)(commit|sha|hash|md5|digest|uuid|guid|checksum|revision|build|version|order|invoice|phone|isbn|etag|id)\W{0,4}$"
# How published kinds of keys begin.
_PREFIX = r"(?:AKIA|ASIA|ghp_|gho_|sk_|pk_|xox[a-z]-|AIza|eyJ)"
_KEY = r"A-Za-z0-9_+/-"
#: A value that an asking name is given, up to white space, a quote or the next name of a query; or a run of key characters.
#: The sign before a value is asked for first, though the name's test implies it: that test tries some thirty starts for each
#: alternative, which is far more than all else where it is made at each word.
CANDIDATE = (
    rf"(?<=[=: \"'])(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{_ASKING}[a-z0-9_-]{{0,12}}[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?))(?:(?!&[\w.-]+=)[^\s\"'`,;<>{{}}()]){{6,}}"
    rf"|(?<![{_KEY}])(?=[{_KEY}]{{12}})(?=[A-Za-z_+/-]*[0-9]|{_PREFIX})[{_KEY}]+={{0,2}}"
)
FEATURES = ["length", "digits", "capitals", "marks", "transitions", "hexadecimal", "distinct", "covered", "path", "asked", "named", "assigned", "quoted", "prefixed"]
TREES, DEPTH, SEED, EXAMPLES = 15, 7, 7, 6000
#: Words of the dictionary, and their lengths.
WORDS, SHORTEST, LONGEST = 1000, 4, 10


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def vocabulary(docs: DataFrame, words: int = WORDS) -> list[str]:
    """The `words` words that most documents have, ties by name."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{SHORTEST},{LONGEST}}}(?![\p{{L}}\p{{N}}])"), F.lit(0)))).alias("w"))
    top = found.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words)
    return [r.w for r in top.collect()]


def covered(value: Column, dictionary: list[str]) -> Column:
    """Share of the characters of `value` that words of the dictionary cover, the longest word first at each place."""
    if not dictionary:
        return F.lit(0.0)
    low = F.lower(value)

    def step(state: Column, i: Column) -> Column:
        size = F.lit(0)
        for k in range(SHORTEST, LONGEST + 1):  # the longest test is made last and holds
            if some := [w for w in dictionary if len(w) == k]:
                size = F.when((i + k - 1 <= F.length(value)) & F.substring(low, i, F.lit(k)).isin(some), F.lit(k)).otherwise(size)
        hit = F.when(i < state["next"], 0).otherwise(size)
        return F.struct((state["n"] + hit).alias("n"), F.when(hit > 0, i + hit).otherwise(state["next"]).alias("next"))

    # Without letters enough for a word nothing is covered.
    total = F.aggregate(F.sequence(F.lit(1), F.length(value)), F.struct(F.lit(0).alias("n"), F.lit(1).alias("next")), step, lambda s: s["n"])
    return F.when(value.rlike(rf"\p{{L}}{{{SHORTEST}}}"), total / F.greatest(F.length(value), F.lit(1))).otherwise(0.0)


def features(value: Column, before: Column, after: Column, dictionary: list[str]) -> dict[str, Column]:
    """Features of a candidate `value` between the texts `before` and `after`."""
    near = F.regexp_extract(before, r"(?:[\w.-]+[^\w\s]*\s{0,2}[^\w\s]*\s{0,2}[^\w\s]?){1,2}$", 0)
    return {
        "length": F.length(value).cast("double"),
        "digits": _share(value, "[0-9]"),
        "capitals": _share(value, "[A-Z]"),
        "marks": _share(value, "[^A-Za-z0-9]"),
        "transitions": _share(value, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"),
        "hexadecimal": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
        "covered": covered(value, dictionary),
        "path": F.concat(F.right(before, F.lit(8)), value, F.left(after, F.lit(8))).rlike(r"(^|[^A-Za-z0-9+])[~.]{0,2}/[A-Za-z]|[A-Za-z0-9]/[A-Za-z0-9._-]+/|://|\\\w+\\|\.(html?|js|py|java|png|jpg|json|txt|csv|xml|pem|ya?ml)\b").cast("double"),
        "asked": near.rlike(rf"(?i){_ASKING}").cast("double"),
        "named": near.rlike(_NAMING).cast("double"),
        "assigned": before.rlike(r"[=:]\W{0,3}$").cast("double"),
        "quoted": before.rlike("[\"'`]$").cast("double"),
        "prefixed": value.rlike("^" + _PREFIX).cast("double"),
    }


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """`n` labelled findings. A value's alphabet, length and setting are drawn by hashes: random characters that a name asks
    for, or that have a published form, are secrets; random characters that are named otherwise or not at all, paths with
    random parts, numbers, and words are none, whoever asks for them."""
    seed = lambda k: F.xxhash64(F.lit(k), F.col("id"))
    draw = lambda k, m: F.pmod(seed(k), F.lit(m)).cast("int")
    pick = lambda k, names: F.element_at(F.array(*[F.lit(x) for x in names]), draw(k, len(names)) + 1)
    bits = lambda k: F.concat(F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 512))
    cut = lambda text, k, least, most: F.substring(text, F.lit(1), draw(k, most - least + 1) + least)
    alnum = F.regexp_replace(F.base64(F.unhex(bits("a"))), "[+/=]", "")
    alphabets = [
        bits("h"), F.upper(bits("u")), alnum, F.lower(F.regexp_replace(F.base64(F.unhex(bits("l"))), "[+/=]", "")), F.upper(alnum), F.base64(F.unhex(bits("b"))),
        F.translate(alnum, "AbCdEf", "!#%^*@"), F.translate(alnum, "xYzQ", "_-._"), F.regexp_replace(F.base64(F.unhex(bits("m"))), "[^A-Za-z]", ""),
    ]
    value = F.lit("")
    for i, a in enumerate(alphabets):
        value = F.when(draw("alphabet", len(alphabets)) == i, a).otherwise(value)
    value = cut(value, "size", 8, 64)
    known = F.concat(pick("prefix", ["AKIA", "ghp_", "sk_test_", "AIza", "xoxb-", "eyJ"]), cut(alnum, "known", 16, 40))
    words = ["change", "example", "default", "placeholder", "your", "value", "none", "here", "update", "user", "session", "table", "house", "never", "simple", "string"]
    join = pick("join", ["-", "_", "", "."])
    said = F.concat(pick("w1", words), join, pick("w2", words), join, pick("w3", words), F.when(draw("tail", 3) == 0, draw("number", 99).cast("string")).otherwise(""))
    path = F.concat(pick("root", ["/var/lib/", "/home/", "./data/", "/usr/share/", "C:/work/", "https://files.example/", "s3://store/", "/run/"]), cut(bits("p"), "p1", 6, 40), pick("slash", ["/", "-", ""]), pick("leaf", ["", "token", "key", "part", "x"]), pick("ending", ["", ".txt", ".pem", ".json", "/a"]))
    number = F.substring(F.concat(F.abs(seed("n1")).cast("string"), F.abs(seed("n2")).cast("string")), F.lit(1), draw("digits", 20) + 10)
    uuid = F.concat_ws("-", F.substring(bits("v"), 1, 8), F.substring(bits("v"), 9, 4), F.substring(bits("v"), 13, 4), F.substring(bits("v"), 17, 12))
    prose = pick("prose", ["the", "of that", "und die", "que la", "les", "see", "with", "at", "and then", ""])
    name = F.concat(pick("who", ["", "my ", "db_", "client-", "the ", "APP_"]), pick("ask", ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "TOKEN", "Secret"]))
    other = pick("other", ["commit", "sha", "md5", "digest", "uuid", "checksum", "revision", "build", "order", "invoice", "etag", "id"])
    sign, quote = pick("sign", ["=", ":", " = ", ": ", "=", " ="]), pick("quote", ["", '"', "'", "", "", '"'])
    asks, names, plain = F.concat(prose, F.lit(" "), name, sign, quote), F.concat(prose, F.lit(" "), other, pick("loose", [" ", "=", ": ", " ", ":"])), F.concat(prose, F.lit(" "))
    end = pick("end", [" and", ".", ",", "", "!!", "###", ")"])
    kinds = [  # value, before, after, label
        (value, asks, F.concat(quote, end), 1), (value, asks, F.concat(quote, end), 1), (known, plain, end, 1), (known, asks, F.concat(quote, end), 1),
        (value, names, end, 0), (value, plain, end, 0), (said, asks, F.concat(quote, end), 0), (path, asks, F.concat(quote, end), 0),
        (path, plain, end, 0), (number, plain, end, 0), (uuid, names, end, 0), (said, plain, end, 0),
    ]
    rows = F.lit(None)
    for i, (v, before, after, label) in enumerate(kinds):
        rows = F.when(F.col("id") % len(kinds) == i, F.struct(v.alias("value"), before.alias("before"), after.alias("after"), F.lit(label).alias("label"))).otherwise(rows)
    return spark.range(n).select(F.inline(F.array(rows)))


def corpus_findings(docs: DataFrame) -> DataFrame:
    """Labelled findings from the candidates of `docs`: keys of a published form and length are secrets; numbers, and digests
    that are named as such, are none; all others stay without a label."""
    found = candidates(docs).select(F.explode("_c").alias("c")).select("c.*")
    secret = F.col("value").rlike(r"^(AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35})$")
    other = F.col("value").rlike(r"^[0-9]+$") | F.col("before").rlike(_NAMING) & F.col("value").rlike("^[0-9a-f]{32,64}$")
    return found.withColumn("label", F.when(secret, 1).when(other, 0)).filter("label is not null").select("value", "before", "after", "label")


class Forest:
    """A random forest as nested (feature, bound, left, right) tuples, with a leaf's share of secrets for leaves."""

    def __init__(self, trees: list, dictionary: list[str]) -> None:
        self.trees, self.dictionary = trees, dictionary

    def score(self, row: dict[str, Column]) -> Column:
        """Mean over the trees of the share of secrets, which is how the library votes."""

        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, bound, low, high = node
            return F.when(row[name] <= bound, walk(low)).otherwise(walk(high))

        total = walk(self.trees[0])
        for t in self.trees[1:]:
            total = total + walk(t)
        return total / len(self.trees)


def _written(node):
    """A node of the library's tree, and what is below it, as tuples."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)
    split = node.split()
    low, high = _written(node.leftChild()), _written(node.rightChild())
    return low if low == high else (FEATURES[split.featureIndex()], split.threshold(), low, high)


def fit(findings: DataFrame, dictionary: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """The library's model of labelled findings (value, before, after, label), and its rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = features(F.col("value"), F.col("before"), F.col("after"), dictionary)
    rows = findings.select(*[c.alias(n) for n, c in made.items()], F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows), rows


def written(model, dictionary: list[str]) -> Forest:
    """The library's model as a Forest."""
    return Forest([_written(t._java_obj.rootNode()) for t in model.trees], dictionary)


def train(findings: DataFrame, dictionary: list[str] | None = None, **more) -> Forest:
    """A forest from labelled findings."""
    dictionary = dictionary or []
    return written(fit(findings, dictionary, **more)[0], dictionary)


def train_on(docs: DataFrame) -> Forest:
    """A forest from examples and from all of `docs`, with its vocabulary. Findings are stored: each round of training reads them."""
    known = durable(corpus_findings(docs))
    return train(example_findings(docs.sparkSession).unionByName(known), vocabulary(docs))


def candidates(docs: DataFrame) -> DataFrame:
    """`docs` with _between, the parts of the text around the candidates, and _c: at (characters before it), value, before and after."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({"_runs": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), "_between": F.split(text, CANDIDATE, -1)})

    def candidate(value: Column, k: Column) -> Column:
        before = F.right(F.concat(F.coalesce(F.get("_runs", k - 1), F.lit("")), F.get("_between", k)), F.lit(60))
        # The characters before it: what the parts and candidates up to here have in all.
        at = F.aggregate(F.slice("_between", F.lit(1), k + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice("_runs", F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
        return F.struct(at.alias("at"), value.alias("value"), before.alias("before"), F.left(F.get("_between", k + 1), F.lit(12)).alias("after"))

    return docs.withColumn("_c", F.transform("_runs", candidate))


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """`docs` with findings (at, length, score: all candidates), n_candidates, n_secrets and redacted, the text without secrets."""
    docs = candidates(docs.drop("findings", "n_candidates", "n_secrets", "redacted"))
    made = lambda c: features(c["value"], c["before"], c["after"], forest.dictionary)
    docs = docs.withColumn("_f", F.transform("_c", lambda c: F.struct(c["at"].alias("at"), F.length(c["value"]).alias("length"), *[x.alias("f_" + n) for n, x in made(c).items()])))
    docs = docs.withColumn("_s", F.transform("_f", lambda f: F.struct(f["at"].alias("at"), f["length"].alias("length"), forest.score({n: f["f_" + n] for n in FEATURES}).alias("score"))))
    secret = lambda k: F.get("_s", k)["score"] >= threshold
    said = F.transform("_between", lambda part, k: F.concat(part, F.when(k >= F.size("_runs"), "").when(secret(k), "[secret]").otherwise(F.get("_runs", k))))
    return sealed(docs, {
        "findings": F.col("_s"),
        "n_candidates": F.size("_s").cast("long"),
        "n_secrets": F.size(F.filter("_s", lambda f: f["score"] >= threshold)).cast("long"),
        "redacted": F.array_join(said, ""),
    }).drop("_runs", "_between", "_c", "_f", "_s")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, train_on(docs))
    places = F.transform(F.filter("findings", lambda f: f["score"] >= 0.5), lambda f: F.concat_ws("+", f["at"].cast("string"), f["length"].cast("string")))
    return out.select("doc_id", "n_candidates", "n_secrets", F.array_join(places, " ").alias("places"), F.sha2("redacted", 256).alias("redacted_sha256"))
