"""Secret scan with a random forest against false findings, in DataFrame functions only.

Candidates are runs of at least 16 letters, digits and ``+ / _ -``, and values of at least 6 characters that are
assigned to a name like ``password`` or ``api_key``, whatever characters they have.  Each has features of its
length, its character transitions, its dictionary coverage, its path and its neighbouring words.  A random forest
that is trained on labelled findings removes false ones; its trees become one column expression, so scanning is a
narrow pass.

Transitions and dictionary come from a :class:`Language`: the frequencies of neighbouring characters in all words
of all documents (28 x 28 numbers), and a table of ``BITS`` bits that holds the words of a public vocabulary and
those that make up ``WORD_SHARE`` or more of the documents' words (so at most 1 / ``WORD_SHARE`` of them, however
many documents there are).  Both are of a fixed size and are part of the plan.

The labelled findings are given as (text, secret) rows, each text holding one candidate; the default set is
drawn here from a fixed seed: ``LABELLED`` findings (a bound on the training rows), half of them secrets of
common kinds in assignments and headers, half hashes, identifiers, paths, addresses, numbers, words, and
placeholders where a secret might stand.

Defined cases: null text has no findings; a candidate that stands several times is a finding at each place;
whole candidates are measured, however long; rows are independent (repeated or null ids stay), an empty table
gives an empty table (its language is even); other columns are ignored by the scan and pass through redaction.
"""

from __future__ import annotations

import json
import math
import random
import string
from functools import reduce
from operator import add

import public_tokenizers
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.functions.arithmetic import let
from sievetrace.llm.runtime import table

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}"
LEAST_BYTES, LEAST_VALUE = 16, 6
#: Labelled findings that the default forest is trained on.
LABELLED = 4000
TREES, DEPTH, SEED = 15, 8, 7
#: Share of the trees' votes from which a finding is a secret.
THRESHOLD = 0.5
MASK = "[SECRET]"

#: The public vocabulary whose whole words are the dictionary, and the letters of its shortest ones.
VOCABULARY, LEAST_LETTERS = "word_bpe_49k.json", 4
#: Share of all words from which a word of the documents is in the dictionary too.
WORD_SHARE = 5e-5
#: Bits of the dictionary's table, two for each word: 3 % of other words seem known with 50,000 words.
BITS = 1 << 19
#: Character classes of transitions: 0 an end or another character, 1 to 26 letters, 27 a digit.
CLASSES = 28

#: Words before a secret, and before what only looks like one (fixed values).
HOT = "token|secret|passw|passphrase|pwd|api_?-?key|access_?-?key|auth|bearer|credential|private"
COLD = "commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|revision|build|etag|trace|request|order|version|file|path|see|url"
_NAMED = rf"(?i)(?:{HOT})[\w.\-]*[\"'`\])]*\s*(?::=|=>|=|:)\s*"
#: A value at the end of a text: between quotes, or up to the punctuation that ends a sentence or an argument.
_QUOTED = _NAMED + rf"[\"'`]([^\s\"'`]{{{LEAST_VALUE},}})[\"'`]\S*$"
_BARE = _NAMED + rf"([^\s\"'`,;]{{{LEAST_VALUE},}}?)[\"'`.,;:!?)\]}}#$%&*|>]*$"

FEATURES = ("length", "likelihood", "changes", "digits", "uppers", "dictionary", "alternation", "distinct", "path", "hot", "cold", "assigned", "quoted", "hex")


# -- language


def dictionary(path: str | None = None) -> list[str]:
    """The whole words of a public vocabulary, in order."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    whole = (e.removesuffix("</w>") for e in entries if e.endswith("</w>"))
    return sorted({w for w in whole if len(w) >= LEAST_LETTERS and w.isascii() and w.isalpha()})


def _pairs(word: Column) -> Column:
    """Array of the class pairs of neighbouring characters, ends included, as ``28 * first + second``."""
    of = lambda x: F.when(x.between("a", "z"), F.ascii(x) - 96).when(x.between("0", "9"), 27).otherwise(0)
    classes = F.transform(F.filter(F.split(F.lower(word), ""), lambda x: x != ""), of)
    return let(F.concat(F.array(F.lit(0)), classes, F.array(F.lit(0))), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.get(c, i) * CLASSES + F.get(c, i + 1)))


def _places(word: Column) -> Column:
    """A word's two bits."""
    return let(F.xxhash64(word), lambda h: F.array(F.pmod(h, F.lit(BITS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(BITS))))


def _numbers(values: list, kind: str) -> Column:
    """An array literal of many numbers, which the optimiser folds to one value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Language:
    """Character transitions and words of a corpus, of a fixed size."""

    def __init__(self, words: list[int], transitions: list[float]) -> None:
        self.words, self.transitions = _numbers(words, "bigint"), _numbers(transitions, "double")

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text", known: list[str] | None = None) -> Language:
        """From all words of all texts, counted once, and ``known`` words (by default :func:`dictionary`'s)."""
        spark = docs.sparkSession
        every = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")
        counts = table(every.groupBy("word").agg(F.count("*").alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 0

        seen = counts.select("n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
        pairs = {r.pair: r.n for r in seen.collect()}  # CLASSES * CLASSES rows at most
        of_first = [sum(pairs.get(a * CLASSES + b, 0) for b in range(CLASSES)) for a in range(CLASSES)]
        transitions = [round(math.log2((pairs.get(a * CLASSES + b, 0) + 1) / (of_first[a] + CLASSES)), 6) for a in range(CLASSES) for b in range(CLASSES)]

        often = counts.filter((F.col("n") >= max(2.0, total * WORD_SHARE)) & F.col("word").rlike(rf"^[a-z]{{{LEAST_LETTERS},}}$")).select("word")
        words = often.union(spark.createDataFrame([(w,) for w in (dictionary() if known is None else known)], "word string"))
        bits = words.select(F.explode(_places(F.col("word"))).alias("place")).groupBy(F.expr("place div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
        found = {r["at"]: r.bits for r in bits.collect()}  # BITS / 64 rows at most
        return cls([found.get(k, 0) for k in range(BITS // 64)], transitions)

    def knows(self, word: Column) -> Column:
        """Whether a word is in the dictionary."""
        bit = lambda p: F.getbit(F.get(self.words, (p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
        return F.forall(_places(word), bit)

    def likelihood(self, found: Column) -> Column:
        """Mean binary logarithm of the probabilities of a candidate's transitions."""
        return let(_pairs(found), lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + F.get(self.transitions, x)) / F.size(p))

    def coverage(self, found: Column) -> Column:
        """Characters of a candidate that stand in words of the dictionary."""
        parts = F.split(F.lower(F.regexp_replace(found, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
        return F.aggregate(parts, F.lit(0), lambda s, w: s + F.when(F.length(w) >= LEAST_LETTERS, F.when(self.knows(w), F.length(w)).otherwise(0)).otherwise(0))


# -- candidates and features


def _prefix(word: Column, found: Column) -> Column:
    """What stands before the first place of ``found`` in its word."""
    return F.call_function("substring_index", word, found, F.lit(1))


def _features(found: Column, word: Column, before: Column, language: Language) -> Column:
    """Array of the features (double); ``before`` are the three words before."""
    n = F.length(found)
    low = F.lower(found)
    per = lambda pattern, of=found: F.regexp_count(of, F.lit(pattern)) / n
    context = F.lower(F.concat_ws(" ", before, _prefix(word, found)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = (
        n.cast("double"),
        language.likelihood(found),
        per("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"),
        per("[0-9]"),
        per("[A-Z]"),
        language.coverage(found) / n,
        per("[aeiou](?=[b-df-hj-np-tv-z])", low),
        F.size(F.array_distinct(F.split(found, ""))) / F.least(n, F.lit(64)),  # of an alphabet of about 64
        F.regexp_count(word, F.lit(r"/|\\|://|\.[a-z]{2,4}\b")).cast("double"),
        flag(context.rlike(HOT)),
        flag(context.rlike(rf"\b(?:{COLD})\b")),
        flag(context.rlike(r"[=:]\W*$")),
        flag(context.rlike("[\"'`]$")),
        flag(found.rlike("^[0-9a-f]+$")),
    )
    return F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values))


def _value(words: Column, i: Column) -> Column:
    """The value of at least 6 characters that the word at ``i`` assigns or is assigned to a name for secrets; else empty."""
    told = F.array_join(F.slice(words, F.greatest(i - 1, F.lit(1)), F.least(i + 1, F.lit(3))), " ")
    found = let(told, lambda t: F.when(t.rlike("[=:]"), let(F.regexp_extract(t, _QUOTED, 1), lambda q: F.when(q != "", q).otherwise(F.regexp_extract(t, _BARE, 1)))).otherwise(""))
    return let(found, lambda v: F.when(F.contains(F.get(words, i), v), v).otherwise(""))


def candidates(text: Column, language: Language) -> Column:
    """Array of (candidate, word_index, match_index, features) of a text."""

    def of(words: Column, hot: Column) -> Column:
        def found(i: Column) -> Column:
            word = F.get(words, i)
            runs = F.when((F.octet_length(word) >= LEAST_BYTES) & word.rlike(CANDIDATE), F.regexp_extract_all(word, F.lit(CANDIDATE), 0)).otherwise(F.array().cast("array<string>"))
            value = F.when(hot & (F.octet_length(word) >= LEAST_VALUE), _value(words, i)).otherwise("")
            return let(value, lambda v: F.when(v == "", runs).otherwise(F.concat(F.array(v), F.filter(runs, lambda r: ~F.contains(v, r)))))

        def at(i: Column) -> Column:
            before = F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            return F.transform(found(i), lambda c, k: F.struct(c.alias("candidate"), i.alias("word_index"), k.alias("match_index"), _features(c, F.get(words, i), before, language).alias("features")))

        maybe = lambda i: (F.octet_length(F.get(words, i)) >= F.when(hot, LEAST_VALUE).otherwise(LEAST_BYTES)) & (hot | F.get(words, i).rlike(CANDIDATE))
        return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), maybe), at))

    words = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")
    hot = F.coalesce(text.rlike(f"(?i){HOT}"), F.lit(False))  # most texts have none: their short words are passed over
    return let(F.struct(words.alias("words"), hot.alias("hot")), lambda t: of(t["words"], t["hot"]))


# -- labelled findings


#: Fragments of words in four languages, of which the labelled findings' made-up words are composed (fixed values).
FRAGMENTS = (
    "the and ing tion that with this from what thing there for are was have ment ent able ness over under "
    "der die das und ein ung keit lich heit sch ver ge auf von "
    "les des une que pour dans eau eux aux elle ier oi "
    "los las del para como mente cion ado ido que ar er"
).split()


def labelled(n: int = LABELLED, seed: int = SEED, known: list[str] | None = None) -> list[tuple[str, int]]:
    """``n`` labelled findings: (text with one candidate, 1 for a secret); their words are ``known`` or composed of fragments."""
    rng = random.Random(seed)
    known = dictionary() if known is None else known
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    draw = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    made = lambda k=0: "".join(rng.choice(FRAGMENTS) for _ in range(k or rng.randrange(1, 4)))
    word = lambda: rng.choice(known) if rng.random() < 0.6 else made()
    prose = lambda: " ".join(word() for _ in range(rng.randrange(3, 7)))
    quote = lambda x: rng.choice(["{}", '"{}"', "'{}'", '"{}";', '"{}".', '"{}",', '"{}"###', "`{}`"]).format(x)
    name = lambda: rng.choice(["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "credential", "db_password", "passwd", "pwd"])
    sign = lambda: rng.choice([" = ", "=", ": ", ":", " := ", " => "])

    def secret() -> str:
        value = rng.choice([
            lambda: draw(hexes, rng.choice([32, 40, 64])), lambda: draw(mixed, rng.randrange(20, 65)), lambda: draw(mixed + "+/", 40), lambda: draw(string.ascii_uppercase + string.digits, 20),
            lambda: f"{draw(string.ascii_lowercase, rng.randrange(2, 5))}{rng.choice('_-')}{draw(mixed, rng.randrange(24, 50))}", lambda: "ey" + draw(mixed + "-_", 60), lambda: draw(mixed, 24),
            lambda: draw(mixed, rng.randrange(8, 16)), lambda: draw(mixed + "@!%^*+?-", rng.randrange(10, 20)), lambda: rng.choice(known)[:8] + draw(string.digits, rng.randrange(2, 5)) + rng.choice("!@#$%&*") + draw(mixed, rng.randrange(2, 5)),
        ])()
        return rng.choice([lambda: f"{name()}{sign()}{quote(value)}", lambda: f"{name()}{sign()}{quote(value)}", lambda: f"Authorization: Bearer {draw(mixed, rng.randrange(24, 60))}", lambda: f"export {name().upper()}={quote(value)}", lambda: f'"{name()}": "{value}",'])()

    def other() -> str:
        kinds = [
            lambda: f"{rng.choice(['commit', 'sha1', 'revision', 'build', 'checksum', 'etag', 'digest', 'trace'])}{rng.choice([' ', ': ', '='])}{draw(hexes, rng.choice([32, 40, 64]))}", lambda: draw(hexes, rng.choice([16, 32, 40])),
            lambda: f"uuid {draw(hexes, 8)}-{draw(hexes, 4)}-{draw(hexes, 4)}-{draw(hexes, 4)}-{draw(hexes, 12)}",
            lambda: "/".join([rng.choice(["", "src", "usr", "home", "lib"]), word(), word(), word()]) + rng.choice([".py", ".java", "", "/index"]),
            lambda: f"https://www.{word()}.com/{word()}/{word()}/{draw(string.digits, 5)}", lambda: f"{made(3)}.{draw(string.digits, 2)}@{word()}-{made(4)}.example.com",
            lambda: draw(string.digits, rng.choice([16, 16, 18, 20])), lambda: made(rng.randrange(5, 12)), lambda: made(rng.randrange(5, 9)).upper() + "!!",
            lambda: "_".join(word() for _ in range(6)), lambda: "-".join(word() for _ in range(6)), lambda: "".join(word().capitalize() for _ in range(rng.randrange(3, 6))), lambda: rng.choice("=-_aA#x0") * rng.randrange(17, 60),
            lambda: f"{name()} {made(8)}", lambda: f"{name()}{sign()}{'_'.join(word() for _ in range(rng.randrange(1, 6)))}", lambda: f"{made(6)}{rng.choice(['$$$', '###', '%%%', '&&&', '***'])}",
            lambda: f"{name()}{sign()}{quote(rng.choice(known).ljust(LEAST_VALUE, 's'))}", lambda: f"{name()}{sign()}{quote(rng.choice(['your_{}_here', '<{}>', '${{{}}}', 'my-{}', 'process.env.{}', 'get_{}()', 'config.{}']).format(name()))}",
            lambda: f"{name()}{sign()}{quote(rng.choice('*x.-0') * rng.randrange(6, 12))}", lambda: f"{name()}s{sign()}{draw(string.digits, rng.randrange(6, 10))}", lambda: f"{name()}{sign()}{word()}.{word()}",
        ]
        return rng.choice(kinds)()

    return [(f"{prose()} {other() if k % 2 else secret()} {prose()}", 1 - k % 2) for k in range(n)]


# -- forest


def _tree(node, features: Column) -> Column:
    """A tree as nested conditions; a leaf is the share of secrets among its training rows."""
    if node.numDescendants() == 0:
        no, yes = node.impurityStats().stats()
        return F.lit(float(yes / (no + yes)))
    split = node.split()
    return F.when(F.get(features, F.lit(split.featureIndex())) <= float(split.threshold()), _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))


class Forest:
    """A trained forest as a column expression over a features array, and the language of its features."""

    def __init__(self, model, language: Language) -> None:
        self.model, self.language = model, language

    @classmethod
    def train(cls, findings: DataFrame, language: Language, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        """From labelled findings (text, secret); a bounded table, held in one partition so that the forest is always the same.

        Of a text's candidates the last is its finding: a name before it may look like one.
        """
        rows = findings.select(F.element_at(candidates(F.col("text"), language)["features"], -1).alias("found"), F.col("secret").cast("double").alias("label"), F.size(candidates(F.col("text"), language)).alias("n"))
        rows = rows.filter("n > 0").select("label", *(F.get("found", F.lit(k)).alias(f) for k, f in enumerate(FEATURES))).coalesce(1)
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
        return cls(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", labelCol="label").fit(rows), language)

    def score(self, features: Column) -> Column:
        """Mean vote of the trees."""
        trees = list(self.model._call_java("trees"))
        return reduce(add, (_tree(t.rootNode(), features) for t in trees)) / len(trees)


def default_forest(docs: DataFrame, text_col: str = "text") -> Forest:
    """The forest of the built-in labelled findings, with the language of the documents that it is for."""
    spark: SparkSession = docs.sparkSession
    return Forest.train(spark.createDataFrame(labelled(), "text string, secret int"), Language.fit(docs, text_col))


def _scored(text: Column, forest: Forest) -> Column:
    found = candidates(text, forest.language)
    return F.transform(found, lambda x: let(x, lambda y: F.struct(y["candidate"].alias("candidate"), y["word_index"].alias("word_index"), y["match_index"].alias("match_index"), forest.score(y["features"]).alias("score"))))


def scan(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate: id, word_index, match_index, candidate, score and is_secret."""
    forest = forest or default_forest(docs, text_col)
    found = docs.select(F.col(id_col), F.explode(_scored(F.col(text_col), forest)).alias("found"))
    return found.select(id_col, "found.word_index", "found.match_index", "found.candidate", F.round("found.score", 6).alias("score"), (F.col("found.score") >= threshold).alias("is_secret"))


def findings(docs: DataFrame) -> DataFrame:
    """The registered query: findings with a digest in place of the candidate."""
    return scan(docs).select("doc_id", "word_index", "match_index", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def redact(docs: DataFrame, forest: Forest | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of each row; each secret of a text is replaced by a mask wherever it stands in that text."""
    forest = forest or default_forest(docs, text_col)
    text = F.col(text_col)
    real = F.transform(F.filter(_scored(text, forest), lambda x: x["score"] >= threshold), lambda x: x["candidate"])
    by_length = F.sort_array(F.transform(F.array_distinct(real), lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))), asc=False)
    return docs.withColumn(text_col, F.aggregate(by_length, text, lambda t, s: F.replace(t, s["c"], F.lit(MASK))))
