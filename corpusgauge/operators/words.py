"""Frequent words per category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.ranking import top_per_group
from corpusgauge.functions.text import WS, WS_RANGES
from corpusgauge.operators.outline import headings
from corpusgauge.schema import BASELINE, DOC_KEYS

# Common English words, contractions as the pieces they leave.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma
mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# Words of the trade that carry no topic.
TOPICLESS_WORDS = """
et al e.g i.e fig table section chapter figure figures tables sections chapters paper study studies
research researchers authors author review reviews survey surveys analysis analyses method methods
approach approaches result results conclusion conclusions introduction background related work works
literature discussion discussions summary summaries overview overviews example examples case cases
model models framework frameworks system systems algorithm algorithms technique techniques
methodology methodologies experiment experiments evaluation evaluations performance performances
implementation implementations application applications development developments design designs
process processes comparison comparisons comparative comparatively experimental experimentally
theoretical theoretically empirical empirically practical practically technical technically
""".split()

# Technical terms that count as words although no dictionary has them.
TECHNICAL_TERMS = """
gpu cpu api url http https json xml html css javascript python java c++ c# ruby php sql nosql mongodb
mysql postgresql redis docker kubernetes aws azure gcp cloud serverless microservice rest graphql
websocket tcp udp ip dns ssl tls ssh ftp smtp pop3 imap ldap oauth jwt token session cookie cache cdn
domain subdomain endpoint route path query parameter header body request response status code error
exception stack trace log debug info warn fatal level config setting environment variable constant
enum interface class object method function procedure routine module package library framework sdk
toolkit plugin extension addon widget component element node edge vertex graph tree forest heap queue
list array vector matrix tensor scalar gradient derivative integral sum product quotient remainder
modulo exponent root logarithm sine cosine tangent hyperbolic trigonometric algebraic geometric
arithmetic statistical probabilistic stochastic deterministic algorithmic computational numerical
analytical symbolic logical boolean binary ternary quaternary quinary senary septenary octal decimal
hexadecimal
""".split()

CODE_BLOCK = r"(?s)```.*?```"
INLINE_CODE = r"`[^`\n]*`"
URL = r"https?://[!$-_a-z]+"
# tried once per run of such characters, however long
EMAIL = r"(?<![\p{L}\p{N}_.\-])[\p{L}\p{N}_.\-]++@[\p{L}\p{N}_.\-]+"
SYMBOL = rf"[^\p{{L}}\p{{N}}_{WS_RANGES}]"


def stop_words() -> list[str]:
    return sorted(set(ENGLISH_STOP_WORDS) | set(TOPICLESS_WORDS))


def plain_words(text: Column) -> Column:
    """Lower-case words of a text without code, URLs, addresses and symbols."""
    no_code = F.regexp_replace(F.regexp_replace(text, CODE_BLOCK, ""), INLINE_CODE, "")
    no_url = F.regexp_replace(no_code, URL, "")
    bare = F.regexp_replace(F.regexp_replace(no_url, EMAIL, ""), SYMBOL, " ")
    return F.split(F.lower(bare), f"{WS}+", -1)


def vocabulary_texts(docs: DataFrame, baseline: str = BASELINE, text: str = "md") -> DataFrame:
    """Category and text of the baseline's documents, headings counted again."""
    own = docs.filter(F.col("system") == baseline)
    heads = headings(own, text, [*DOC_KEYS, text])
    return heads.select("category", F.concat_ws("\n", text, F.array_join("heads.title", "\n")).alias("text"))


def word_frequency(
    texts: DataFrame,
    dictionary: DataFrame | None = None,
    top: int = 100,
    text: str = "text",
    by: Sequence[str] = ("category",),
    stops: Sequence[str] | None = None,
) -> DataFrame:
    """The ``top`` words per group with their counts, ties in word order.

    A word has three letters or more, a vowel, no digit, is not a stop word,
    and is in ``dictionary`` (one ``word`` column) or a technical term; with no
    dictionary every such word counts.  The dictionary meets the counts, not
    the tokens.
    """
    by = list(by)
    stops = stop_words() if stops is None else list(stops)
    word = F.col("word")
    # cheap tests before counting, patterns once per distinct word after it
    tokens = texts.select(*by, F.explode(plain_words(F.col(text))).alias("word")).filter(
        (F.length(word) >= 3) & ~word.isin(stops)
    )
    counts = tokens.groupBy(*by, "word").agg(F.count("*").alias("count")).filter(
        word.rlike(r"\A[\p{L}\p{N}]+\z") & ~word.rlike(r"\p{Nd}") & word.rlike("[aeiouy]")
    )
    if dictionary is not None:
        known = dictionary.select(F.col("word").alias("entry")).distinct()
        listed = counts.join(known, F.col("word") == F.col("entry"), "left")
        counts = listed.filter(F.col("entry").isNotNull() | word.isin(TECHNICAL_TERMS)).drop("entry")
    return top_per_group(counts, by, [F.col("count").desc(), word], top)
