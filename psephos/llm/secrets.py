"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

Candidates are cast wide: runs of token characters, long or with a digit; web
tokens with their dots; known prefixes; whatever is assigned to or passed as
a secret; passwords in addresses; blocks of private keys over several lines. The
forest judges them by length, character transitions, the share that
dictionary words of the corpus cover, the path around them and the words next
to them. It learns from labelled findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import LOWER, UPPER, durable, lower_az

# A dotted web token, a known prefix with its key, or a run of token characters with a digit or of some length.
RUN = (
    "eyJ[A-Za-z0-9_\\-]{8,}(?:\\.[A-Za-z0-9_\\-]+){1,2}"
    "|(?:AKIA|ASIA|gh[pousr]_|glpat-|sk_live_|sk-|xox[abprs]-|AIza)[A-Za-z0-9_\\-]{10,}"
    "|(?:(?=[A-Za-z+/_\\-]{0,64}[0-9])[A-Za-z0-9+/_\\-]{16,}|[A-Za-z0-9+/_\\-]{20,})={0,2}"
)
# A key block of any length. Headers as of encrypted keys may hold single dashes, 64 at most.
PEM = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]++(?:-(?!----)[^-]*+){0,64}+-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
BLOCK = "-----BLOCK-----"  # stands for such a block among the words
LOGIN = "://[^\\s:/@]+:([^\\s/@]{3,})@"

# Words that stand next to secrets, and next to strings that look like them.
SECRET_WORDS = "token|secret|passw|pwd|api_?key|apikey|access_?key|auth|credential|bearer|private|client_?secret|signature"
PLAIN_WORDS = "commit|revision|checksum|sha1|sha256|md5|hash|digest|uuid|guid|order|invoice|phone|tel|card|isbn|build|version|figure|page|file|image"

ASSIGNED = f"(?i)(?:{SECRET_WORDS}|(?<![a-z])key(?![a-z]))[a-z0-9_.\\-]*[\"'`]?[=:]+"  # at the end of the text before a value, or before a value in a word
PASSED = "(?i)^[\"'(]*(?:bearer|token|secret|password|passwd|pwd)[\"':]*$"
VALUE = "[\"'`]?([^\"'`,;]{4,})"

FEATURES = [
    "length", "digits", "uppers", "lowers", "signs", "transitions", "variety", "hex_only", "digits_only",
    "common_pairs", "dictionary", "in_path", "has_extension", "in_address", "secret_near", "plain_near", "assigned", "quoted",
]

FINDING = ["before2", "before1", "lead", "candidate", "tail", "after1"]


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the documents that labelled findings are derived from; ``words`` bounds the dictionary."""

    sample: int = 3000
    words: int = 2000
    pairs: int = 250
    trees: int = 24
    depth: int = 7
    threshold: float = 0.5
    seed: int = 19


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, word_at, run_at`` and the columns of a finding for every candidate; null and empty texts have none. A block of a private key counts as one word."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    some = rows.where(F.col("text").rlike(f"{RUN}|{ASSIGNED}|(?i:bearer|token|secret|passw|pwd)\\S*\\s|{LOGIN}|{PEM}"))
    has = F.col("text").contains("PRIVATE KEY")
    some = some.withColumn("blocks", F.when(has, F.regexp_extract_all("text", F.lit(PEM), F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = some.withColumn("text", F.when(has, F.regexp_replace("text", PEM, f" {BLOCK} ")).otherwise(F.col("text"))).withColumn("words", F.split("text", "[\\x20\\x09-\\x0D]+", -1))
    spot = lambda i, d: F.coalesce(F.get("words", i + d), F.lit(""))
    # a word of four characters or more after "key =", "key: =" or a word that announces a secret
    follows = lambda w, i: (F.length(w) >= 4) & (spot(i, -1).rlike(PASSED) | (spot(i, -1).rlike("[=:]$") & F.concat(spot(i, -2), spot(i, -1)).rlike(f"{ASSIGNED}$")))
    wanted = lambda x: x["w"].rlike(f"{RUN}|{ASSIGNED}{VALUE}|{LOGIN}|^{BLOCK}$") | follows(x["w"], x["i"])
    marked = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), wanted)
    near = lambda d: spot(F.col("m.i"), d)
    found = some.select("id", "words", "blocks", F.explode(marked).alias("m")).select("id", "words", "blocks", "m", F.col("m.i").alias("word_at"), F.col("m.w").alias("word"))
    runs = F.regexp_extract_all("word", F.lit(RUN), F.lit(0))
    bare = F.regexp_extract("word", "^[\"'`(\\[{<]*(.*?)[\"'`)\\]}>,;.]*$", 1)
    value = F.coalesce(*[F.nullif(F.regexp_extract("word", x, 1), F.lit("")) for x in (f"{ASSIGNED}{VALUE}", LOGIN)], bare)
    nth = F.size(F.filter(F.slice("words", F.lit(1), F.col("word_at")), lambda w: w == BLOCK))
    block = F.regexp_replace(F.get("blocks", nth), "\\s+", "")
    lone = F.when((F.col("word") == BLOCK) & (F.size("blocks") > nth), block).when(F.col("word").rlike(LOGIN), F.regexp_extract("word", LOGIN, 1)).when(F.size(runs) == 0, value)
    found = found.withColumn("lone", lone).withColumn("runs", F.when(F.col("lone").isNotNull(), F.array("lone")).otherwise(runs))
    # what lies between the runs: the text before a run is all between and all runs before it
    at = F.position(F.col("lone"), F.col("word"))
    cut = F.array(F.substring("word", F.lit(1), at - 1), F.substring("word", at + F.length("lone"), F.length("word")))
    found = found.withColumn("between", F.when(F.col("lone").isNotNull(), F.when(F.col("word") == BLOCK, F.array(F.lit(""), F.lit(""))).otherwise(cut)).otherwise(F.split("word", RUN, -1)))
    each = found.select("id", "word_at", "runs", "between", near(-2).alias("before2"), near(-1).alias("before1"), near(1).alias("after1"), F.posexplode("runs").alias("run_at", "candidate"))
    upto = F.transform(F.sequence(F.lit(0), F.col("run_at")), lambda j: F.concat(F.coalesce(F.get("between", j), F.lit("")), F.when(j < F.col("run_at"), F.get("runs", j)).otherwise("")))
    rest = F.transform(F.sequence(F.col("run_at") + 1, F.size("runs")), lambda j: F.concat(F.coalesce(F.get("between", j), F.lit("")), F.coalesce(F.get("runs", j), F.lit(""))))
    return each.where(F.length("candidate") > 0).select(
        "id", "word_at", "run_at", "before2", "before1", F.array_join(upto, "").alias("lead"), "candidate", F.array_join(rest, "").alias("tail"), "after1"
    )


def dictionary(docs: DataFrame, text_col: str = "text", p: Params = Params()) -> DataFrame:  # noqa: B008
    """``word, n``: words of four or more letters with a count over a threshold, which a histogram sets so that ``p.words`` of them are left at most.

    The histogram has a fixed number of bins of the logarithm of the count, so nothing that grows with the documents is sorted or collected.
    """
    words = docs.select(F.explode(F.split(lower_az(docs[text_col].cast("string")), "[^a-z]+")).alias("word")).where(F.length("word").between(4, 40))
    counts = durable(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    bins = counts.groupBy(F.floor(F.log2("n") * 64).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    least, room = 1 << 62, p.words
    for r in sorted(bins.collect(), key=lambda r: -r.bin):
        if r.words > room:
            break
        room, least = room - r.words, r.least
    return counts.where(F.col("n") >= least)


def pieces_of(words: list, size: int, most: int) -> list[str]:
    """The most frequent substrings of a length in the dictionary."""
    n: dict[str, int] = {}
    for r in words:
        for i in range(len(r.word) - size + 1):
            n[r.word[i : i + size]] = n.get(r.word[i : i + size], 0) + r.n
    return sorted(n, key=lambda g: (-n[g], g))[:most]


def featured(findings: DataFrame, pairs: list[str], quads: list[str]) -> DataFrame:
    """The findings with the columns of ``FEATURES``."""
    c, low = F.col("candidate"), lower_az(F.col("candidate"))
    n = F.length(c).cast("double")
    share = lambda chars: F.length(F.regexp_replace(c, f"[^{chars}]", "")) / n
    shape = F.translate(F.translate(F.translate(c, UPPER, "A" * 26), LOWER, "a" * 26), "0123456789", "0" * 10)
    grams = lambda size: F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(low, i, F.lit(size)))
    known = lambda size, table: F.size(F.filter(grams(size), lambda g: g.isin(table or [""]))) / (n - (size - 1))
    around = lower_az(F.concat_ws(" ", "before2", "before1", "lead"))
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    values = {
        "length": F.least(n, F.lit(256.0)), "digits": share("0-9"), "uppers": share("A-Z"), "lowers": share("a-z"), "signs": share("+/_=\\-"),
        "transitions": (F.length(F.regexp_replace(shape, "(.)\\1*", "$1")) - 1) / n,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
        "hex_only": yes(low.rlike("^[0-9a-f]+$")), "digits_only": yes(c.rlike("^[0-9+\\-]+$")),
        "common_pairs": known(2, pairs), "dictionary": F.when(n >= 4, known(4, quads)).otherwise(0.0),
        "in_path": yes(F.col("lead").contains("/") | c.rlike("/[^/]*/") | c.rlike("^/")), "has_extension": yes(F.col("tail").rlike("^\\.[A-Za-z]{1,4}\\b")),
        "in_address": yes(F.col("lead").rlike("://|@|www\\.") | F.col("tail").rlike("^@")),
        "secret_near": yes(around.rlike(SECRET_WORDS)), "plain_near": yes(around.rlike(PLAIN_WORDS)),
        "assigned": yes(F.concat_ws(" ", "before1", "lead").rlike("[=:]\\s*[\"'`]?$")), "quoted": yes(F.col("lead").rlike("[\"'`]$") & F.col("tail").rlike("^[\"'`]")),
    }
    return findings.withColumns(values)


def derived_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:  # noqa: B008
    """Labelled findings where none are given: a finding's columns and ``label``.

    About ``p.sample`` documents, drawn by a seeded hash of the id, give twenty
    findings each. Random strings come from digests of the id, and words from
    the text. Secrets are such strings where a secret is assigned or passed, or with
    a known prefix anywhere, chosen passwords, dotted tokens and key blocks; the
    rest are the same strings as checksums or in paths, card numbers,
    identifiers and compounds made of words, dates, and rulers.
    """
    top, n = 1 << 62, docs.count()
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("k"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(p.seed), "k"), F.lit(top)) < min(top, int(top * (p.sample / max(n, 1)))))
    pick = lambda salt, *values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.lit(salt), "k"), F.lit(len(values))) + 1).cast("int"))
    made = {
        "hexes": F.concat(F.sha1(F.concat(F.lit("a"), "k")), F.sha1(F.concat(F.lit("b"), "k"))),
        "mixed": F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("c"), "k"), 512))), "[+/=]", "7"),
        "digits": F.regexp_replace(F.sha2(F.concat(F.lit("d"), "k"), 512), "[^0-9]", ""),
        "words": F.slice(F.split(F.regexp_replace(lower_az(F.col("text")), "[^a-z ]", ""), " +"), 1, 12),
    }
    drawn = durable(drawn.withColumns(made).drop("text"), "drawn")  # p.sample rows or so; written, as each is used many times below
    hexes, mixed, digits, words = (F.col(c) for c in made)
    word = lambda i: F.coalesce(F.nullif(F.get(words, F.lit(i)), F.lit("")), F.lit("word"))
    random = F.when(pick(1, 0, 1) == 0, F.substring(hexes, F.lit(1), pick(2, 32, 40, 64))).otherwise(F.substring(mixed, F.lit(1), pick(3, 20, 24, 32, 40, 64)))

    def finding(label: int, candidate: Column, before2, before1, lead, tail, after1=None) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        parts = zip(FINDING, (before2, before1, lead, candidate, tail, word(7) if after1 is None else after1), strict=True)
        return F.struct(*[as_column(v).cast("string").alias(k) for k, v in parts], F.lit(label).alias("label"))

    name = pick(4, "token", "api_key", "secret", "password", "auth_token", "client_secret", "access_key", "TOKEN", "API_KEY", "apikey")
    mark, quote = pick(5, "=", ":", "="), pick(6, '"', '"', "'", "")
    one_word = finding(1, random, word(1), word(2), F.concat(name, mark, quote), quote)
    three_words = finding(1, random, name, mark, quote, F.concat(quote, pick(17, "", "", "###", "&&&", "!!", ".", ",", ";")))
    passed = finding(1, random, pick(18, "Authorization:", "auth", "use"), pick(7, "Bearer", "token", "secret:", "password"), "", "")
    prefixed = F.concat(pick(8, "AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-"), F.substring(mixed, F.lit(9), F.lit(24)), pick(9, "1", "22", "303"))
    checksum = finding(0, hexes.substr(F.lit(1), pick(10, 32, 40, 64)), word(3), pick(11, "commit", "md5", "sha1:", "checksum", "revision", "hash", "digest"), "", pick(12, "", ".", ","))
    path = finding(0, F.concat(word(1), F.lit("/"), word(4), F.lit("-"), F.substring(hexes, F.lit(5), F.lit(10))), word(2), word(3), pick(13, "/static/", "https://cdn.example.org/", "./build/"), pick(14, ".js", ".css", ".png"))
    card = finding(0, F.rpad(F.substring(digits, F.lit(1), F.lit(16)), 16, "4"), word(2), word(3), pick(15, "", "", "+", "("), pick(16, "", "$$$", "###", "."))
    made = finding(0, F.concat_ws("_", word(1), word(2), word(5), word(6), F.substring(digits, F.lit(1), F.lit(3))), word(2), pick(19, "=", "see", "in", ":"), "", "")
    date = finding(0, F.concat(F.lit("20"), F.rpad(F.substring(digits, F.lit(1), F.lit(2)), 2, "1"), F.lit("-01-02-10-20-30")), word(2), word(3), "", pick(20, "", ".log", "Z"))
    repeated = finding(0, F.concat(F.repeat(F.substring(hexes, F.lit(1), F.lit(1)), 20), F.lit("0")), pick(21, "token", "secret", "key"), "=", '"', '"')
    given = F.array(one_word, three_words, passed, finding(1, prefixed, word(2), word(3), "", ""), checksum, path, card, made, date, repeated)
    chosen = F.concat(pick(22, "Sun", "river", "Blue", "go"), word(3), pick(23, "!", "#", "", "$"), F.substring(digits, F.lit(1), F.lit(3)))
    password = finding(1, chosen, pick(24, "password", "passwd", "pwd", "db_password"), mark, quote, quote)
    login = finding(1, chosen, word(1), word(2), F.concat(F.lit("https://"), word(4), F.lit(":")), "@db.example.org")
    dotted = finding(1, F.concat(F.lit("eyJ"), F.substring(mixed, F.lit(1), F.lit(20)), F.lit("."), F.substring(mixed, F.lit(21), F.lit(40))), pick(25, "token", "Authorization:", "jwt"), pick(26, "=", "Bearer", ":"), quote, quote)
    letters = finding(1, F.translate(F.substring(mixed, F.lit(30), F.lit(24)), "0123456789", "qzXwvKjyBf"), name, mark, quote, quote)
    key = finding(1, F.concat(F.lit("-----BEGINRSAPRIVATEKEY-----"), mixed, mixed, F.lit("-----ENDRSAPRIVATEKEY-----")), word(1), word(2), "", "")
    brief = F.substring(F.regexp_replace(mixed, "^[A-Za-z]*", ""), F.lit(1), pick(36, 5, 6, 8, 9))
    short = finding(1, brief, pick(37, word(2), ""), pick(38, "password:", "pwd", "passwd:", ""), pick(39, "pwd=", "KEY=", "password=", "key:", "secret="), "")
    joined = F.substring(F.concat(*[word(i) for i in range(1, 9)]), F.lit(1), pick(33, 20, 22, 26, 32))
    compound = finding(0, joined, word(9), word(10), "", pick(27, "", ".", ","))
    name_like = finding(0, F.initcap(joined), word(9), pick(34, word(10), "token", ""), "", pick(35, "", ".", ","))
    spoken = finding(0, word(2), pick(28, "password", "token", "secret", "the"), pick(29, ":", "=", "is:"), "", pick(30, "", ".", ","))
    ruler = finding(0, F.repeat(pick(31, "-", "=", "_", "a", "ha"), 24), word(1), word(2), "", "")
    more = F.array(password, login, dotted, letters, key, short, compound, name_like, spoken, ruler)
    return drawn.select(F.explode(F.concat(given, more)).alias("f")).select("f.*").where(F.length("candidate") >= 3)


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()  # noqa: B008
) -> DataFrame:
    """Every candidate with the forest's ``probability`` that it is a secret, and ``is_secret``.

    Returns ``id, word_at, run_at, candidate, probability, is_secret``:
    ``word_at`` counts words from 0, ``run_at`` runs in the word. ``labelled``
    has the columns ``before2, before1, lead, candidate, tail, after1`` and
    ``label`` (0 or 1; other values and nulls are left out); without it
    findings are derived from the documents. With one label only, or none,
    every probability is that label's (0 without labels). Null and empty texts have no
    candidate. Repeated rows give repeated findings; a null id is kept.
    """
    words = dictionary(docs, text_col, p).collect()  # p.words rows at most
    pairs, quads = pieces_of(words, 2, p.pairs), pieces_of(words, 4, 4 * p.words)
    learnt = (derived_findings(docs, id_col, text_col, p) if labelled is None else labelled).where("label IN (0, 1)")
    learnt = durable(featured(learnt.select(*FINDING, F.col("label").cast("double")), pairs, quads).select("label", *FEATURES).na.fill(0.0), "findings")
    found = featured(candidates(docs, id_col, text_col), pairs, quads)
    labels = [r.label for r in learnt.select("label").distinct().collect()]
    if len(labels) < 2:
        scored = found.withColumn("probability", F.lit(labels[0] if labels else 0.0))
    else:
        put = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=p.trees, maxDepth=p.depth, seed=p.seed, probabilityCol="both")
        model = forest.fit(put.transform(learnt))
        scored = model.transform(put.transform(found)).withColumn("probability", F.get(vector_to_array("both"), F.lit(1)))
    return scored.select("id", "word_at", "run_at", "candidate", F.round("probability", 9).alias("probability"), (F.col("probability") >= p.threshold).alias("is_secret"))
