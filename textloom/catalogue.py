"""Registered queries of the annotators and corpus statistics, and their SQL counterparts.

Each query reads whole tables. Long texts are compared by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import chars, text
from textloom.operators import capture, langid, merging, normalize, pii, sentences, spot, stats, tokenize, vectors
from textloom.plans import pipeline as plans
from textloom.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "documents")


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_SQL_WORDS = "(SELECT doc_id, lang, i - 1 AS ix, w[i] AS term FROM (SELECT doc_id, lang, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)))"


# --- normalizers -------------------------------------------------------------------------------------------------


@register("SELECT doc_id, sha256(lower(regexp_replace(text, '[\\x00-\\x09\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g'))) AS cleaned FROM documents")
def q_clean_lower(spark, folder):
    return _docs(spark, folder).select("doc_id", _sha(text.lower_case(text.remove_control_characters(F.col("text")))).alias("cleaned"))


@register("SELECT doc_id, sha256(replace(upper(text), 'ẞ', 'ß')) AS upper_text FROM documents")
def q_upper_simple(spark, folder):
    return _docs(spark, folder).select("doc_id", _sha(text.upper_case(F.col("text"))).alias("upper_text"))


@register("SELECT doc_id, sha256(replace(translate(text, 'áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ', 'aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN'), 'ß', 'ss')) AS folded FROM documents")
def q_fold_ascii(spark, folder):
    return _docs(spark, folder).select("doc_id", _sha(text.fold_to_ascii(F.col("text"))).alias("folded"))


@register("SELECT doc_id, sha256(translate(text, 'áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ', 'aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN')) AS plain FROM documents")
def q_remove_diacritics(spark, folder):
    return _docs(spark, folder).select("doc_id", _sha(text.remove_diacritics(F.col("text"))).alias("plain"))


@register("SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[\"''`‘’“”«»‹›„‚]', '', 'g'), '\\s+', ' ', 'g'))) AS trimmed FROM documents")
def q_strip_quotes(spark, folder):
    return _docs(spark, folder).select("doc_id", _sha(text.remove_quotes_and_trim(F.col("text"))).alias("trimmed"))


@register("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, 'Æ', 'AE'), 'æ', 'ae'), 'Œ', 'OE'), 'œ', 'oe'), 'ﬁ', 'fi')) AS split_letters FROM documents")
def q_remove_ligatures(spark, folder):
    return _docs(spark, folder).select("doc_id", _sha(text.remove_ligatures(F.col("text"))).alias("split_letters"))


@register("SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(text, '(?s)(?:[^\\s\\pP]|'')+|[\\s\\pP]'), lambda w: concat(replace(upper(substr(w, 1, 1)), 'ẞ', 'ß'), lower(substr(w, 2)))), '')) AS titled FROM documents")
def q_title_case(spark, folder):
    return _docs(spark, folder).select("doc_id", _sha(text.title_case(F.col("text"))).alias("titled"))


@register("""SELECT page_id, sha256(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', ' ', 'g')) AS plain FROM pages""")
def q_html_strip(spark, folder):
    return _t(spark, folder, "pages").select("page_id", _sha(text.strip_tags(F.col("html"))).alias("plain"))


# --- tokens and predicates ---------------------------------------------------------------------------------------


@register("SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: NOT regexp_matches(x, '^\\s*$'))) AS BIGINT) AS n_tokens, sha256(array_to_string(list_filter(string_split(text, ' '), lambda x: NOT regexp_matches(x, '^\\s*$')), '|')) AS joined FROM documents")
def q_space_tokens(spark, folder):
    tokens = _docs(spark, folder).select("doc_id", tokenize.space_tokens(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), _sha(F.array_join(F.transform("tokens", lambda t: t["value"]), "|")).alias("joined"))


@register(f"SELECT lang, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT term) AS BIGINT) AS n_terms FROM {_SQL_WORDS} GROUP BY lang")
def q_token_counts(spark, folder):
    return stats.exploded_words(_docs(spark, folder), "doc_id", "text", "lang").groupBy("lang").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


@register(f"SELECT doc_id, CAST(ix AS BIGINT) AS ix, term FROM {_SQL_WORDS}")
def q_tokens_exploded(spark, folder):
    return stats.exploded_words(_docs(spark, folder)).select("doc_id", F.col("ix").cast("long").alias("ix"), "term")


@register()
def q_fast_tokens(spark, folder):
    tokens = _docs(spark, folder).select("doc_id", tokenize.fast_tokens(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), _sha(tokenize.tokenized_value(F.col("tokens"))).alias("joined"))


_PREDICATES = {
    "capitalized": (chars.is_capitalized, "regexp_matches(x, '^\\p{Lu}') AND regexp_matches(x, '\\p{Ll}')"),
    "all_upper": (chars.is_all_upper, "NOT regexp_matches(x, '\\p{Ll}')"),
    "all_lower": (chars.is_all_lower, "NOT regexp_matches(x, '\\p{Lu}')"),
    "letter_or_digit": (chars.is_letter_or_digit, "regexp_matches(x, '^[\\p{L}\\p{Nd}]+$')"),
    "letter": (chars.is_letter, "regexp_matches(x, '^\\p{L}+$')"),
    "digit": (chars.is_digit, "regexp_matches(x, '^\\p{Nd}+$')"),
    "is_numeric": (chars.is_numeric, "regexp_matches(x, '^[0-9]+$')"),
    "has_numeric": (chars.has_numeric, "regexp_matches(x, '[0-9]')"),
    "sentence_mark": (chars.is_sentence_punctuation, "regexp_matches(x, '^[…:;!?.]+$')"),
    "has_punctuation": (chars.has_punctuation, "regexp_matches(x, '\\pP')"),
    "punctuation": (chars.is_punctuation, "regexp_matches(x, '^\\pP+$')"),
    "is_symbol": (chars.is_symbol, "regexp_matches(x, '^\\pS+$')"),
    "hyphen": (chars.is_hyphen, "regexp_matches(x, '^[-–—~]+$')"),
    "email": (chars.like_email, f"regexp_matches(x, '^{_EMAIL}$')"),
    "ligatures": (chars.has_ligatures, "regexp_matches(x, '[ÆæŒœﬁﬂ]')"),
}
#: Forms that the tables lack, put after each text so that every predicate is true of something.
_RARE = " ﬁn Œuvre  € “ \" http://a.org/b 😀"
_SQL_PIECES = "(SELECT doc_id, unnest(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) AS x FROM documents)"
_SQL_PIECES_AND_RARE = _SQL_PIECES.replace("replace(text,", f"replace(text || '{_RARE}',")


@register("SELECT doc_id, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"CAST(sum(CASE WHEN {sql} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, (_, sql) in _PREDICATES.items()) + f" FROM {_SQL_PIECES_AND_RARE} GROUP BY doc_id")
def q_predicates(spark, folder):
    pieces = _docs(spark, folder).select("doc_id", F.explode_outer(F.array_remove(F.split(F.replace(F.concat("text", F.lit(_RARE)), F.lit("\n"), F.lit(" ")), " "), "")).alias("x")).where("x is not null")
    return pieces.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.sum(f(F.col("x")).cast("long")).alias(name) for name, (f, _) in _PREDICATES.items()])


_SQL_SHAPE = "translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[/\\\\]', chr(1), 'g'), '~', chr(2), 'g'), '@', chr(3), 'g'), '[-–—]', chr(4), 'g'), '\\p{Ll}', chr(5), 'g'), '\\p{Lu}', chr(6), 'g'), '\\pN', chr(7), 'g'), '\\pP', chr(8), 'g'), '[^\\x01-\\x08]', '#', 'g'), chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8), '/~@-xX9.')"


@register(f"SELECT shape, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_SQL_SHAPE} AS shape FROM {_SQL_PIECES}) GROUP BY shape")
def q_shape_histogram(spark, folder):
    pieces = _docs(spark, folder).select(F.explode_outer(F.array_remove(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " "), "")).alias("x")).where("x is not null")
    return pieces.groupBy("x").agg(F.count("*").alias("n")).groupBy(chars.shape(F.col("x")).alias("shape")).agg(F.sum("n").alias("n"))


@register(f"SELECT w.doc_id, CAST(w.ix AS BIGINT) AS ix, w.term, lag(term, 2) OVER win AS previous_2, lag(term, 1) OVER win AS previous_1, lead(term, 1) OVER win AS next_1, lead(term, 2) OVER win AS next_2 FROM {_SQL_WORDS} w WINDOW win AS (PARTITION BY doc_id ORDER BY ix)")
def q_context_window(spark, folder):
    return stats.context_window(stats.exploded_words(_docs(spark, folder)).withColumn("ix", F.col("ix").cast("long")), 2)


@register(f"SELECT doc_id, CAST(ix AS BIGINT) AS ix, CASE WHEN tag IS NULL THEN 'O' WHEN lag(tag) OVER win IS DISTINCT FROM tag AND lead(tag) OVER win IS DISTINCT FROM tag THEN 'U-' || tag WHEN lag(tag) OVER win IS DISTINCT FROM tag THEN 'B-' || tag WHEN lead(tag) OVER win IS NOT DISTINCT FROM tag THEN 'I-' || tag ELSE 'L-' || tag END AS bilou FROM (SELECT doc_id, ix, CASE WHEN regexp_matches(term, '^[0-9]+$') THEN 'NUM' WHEN length(term) <= 2 THEN 'SHORT' END AS tag FROM {_SQL_WORDS}) WINDOW win AS (PARTITION BY doc_id ORDER BY ix)")
def q_bilou(spark, folder):
    tokens = stats.exploded_words(_docs(spark, folder))
    tagged = tokens.select("doc_id", F.col("ix").cast("long").alias("ix"), F.when(chars.is_numeric(F.col("term")), "NUM").when(F.length("term") <= 2, "SHORT").alias("tag"))
    return stats.bilou(tagged).select("doc_id", "ix", "bilou")


_W, _H = "[\\p{L}\\p{Nd}]+", "[-–—~]"


@register(f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{Nd}}\\pP])({_W}(?: ?{_H} ?{_W})+)', 1)) AS word FROM documents) GROUP BY word")
def q_hyphenated(spark, folder):
    return _docs(spark, folder).select("doc_id", F.explode_outer(capture.hyphenated_words(F.col("text"))).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))


# --- personal data -----------------------------------------------------------------------------------------------


@register(f"SELECT doc_id, found, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS found FROM documents) GROUP BY doc_id, found")
def q_email_findings(spark, folder):
    found = pii.Analyzer("en", [pii.EMAIL]).analyze(_docs(spark, folder))
    each = found.select("doc_id", "text", F.explode_outer("findings").alias("f")).where("f is not null")
    return each.select("doc_id", F.substring("text", F.col("f.start") + 1, F.col("f.end") - F.col("f.start") + 1).alias("found")).groupBy("doc_id", "found").agg(F.count("*").alias("n"))


@register(f"SELECT doc_id, sha256(regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g')) AS replaced FROM documents")
def q_replace_emails(spark, folder):
    found = pii.Analyzer("en", [pii.EMAIL]).analyze(_docs(spark, folder))
    return found.select("doc_id", _sha(pii.anonymize(F.col("text"), F.col("findings"), "replace", replacement="<EMAIL>")).alias("replaced"))


@register(f"SELECT doc_id, sha256(regexp_replace(text, '{_EMAIL}', '', 'g')) AS redacted FROM documents")
def q_redact_emails(spark, folder):
    found = pii.Analyzer("en", [pii.EMAIL]).analyze(_docs(spark, folder))
    return found.select("doc_id", _sha(pii.anonymize(F.col("text"), F.col("findings"), "redact")).alias("redacted"))


@register(f"SELECT doc_id, sha256(CASE WHEN len(m) = 0 THEN text ELSE list_reduce(list_prepend(text, list_distinct(m)), lambda acc, x: replace(acc, x, repeat('*', CAST(length(x) AS INTEGER)))) END) AS masked FROM (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)")
def q_mask_emails(spark, folder):
    found = pii.Analyzer("en", [pii.EMAIL]).analyze(_docs(spark, folder))
    return found.select("doc_id", _sha(pii.anonymize(F.col("text"), F.col("findings"), "mask")).alias("masked"))


@register(f"SELECT doc_id, sha256(CASE WHEN len(m) = 0 THEN text ELSE list_reduce(list_prepend(text, list_distinct(m)), lambda acc, x: replace(acc, x, sha256(x))) END) AS hashed FROM (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)")
def q_hash_emails(spark, folder):
    found = pii.Analyzer("en", [pii.EMAIL]).analyze(_docs(spark, folder))
    return found.select("doc_id", _sha(pii.anonymize(F.col("text"), F.col("findings"), "hash")).alias("hashed"))


@register(f"SELECT value, 'EMAIL_ADDRESS_' || CAST(row_number() OVER (ORDER BY first_doc, first_at) AS VARCHAR) AS name FROM (SELECT value, min(doc_id) AS first_doc, min(doc_id * 1000000 + pos) AS first_at FROM (SELECT doc_id, m AS value, instr(text, m) AS pos FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_EMAIL}')) AS m FROM documents)) GROUP BY value)")
def q_cloak_names(spark, folder):
    return pii.cloak_dictionary(pii.Analyzer("en", [pii.EMAIL]).analyze(_docs(spark, folder)))


@register("SELECT doc_id, sha256(text) AS back FROM documents")
def q_cloak_round_trip(spark, folder):
    cloaked = pii.cloak(pii.Analyzer("en", [pii.EMAIL, pii.IP]).analyze(_docs(spark, folder)))
    return cloaked.select("doc_id", _sha(pii.rehydrate(F.col("cloaked"), F.col("mapping"))).alias("back"))


@register()
def q_all_findings(spark, folder):
    found = pii.Analyzer("en").add_all().analyze(_docs(spark, folder))
    return found.select("lang", F.explode_outer("findings").alias("f")).where("f is not null").groupBy("lang", "f.entity_type").agg(F.count("*").alias("n"))


@register()
def q_abbreviations(spark, folder):
    found = _docs(spark, folder).select("doc_id", F.explode_outer(capture.abbreviations(F.col("text"))).alias("a")).where("a is not null")
    return found.select("doc_id", "a.abbreviation", "a.description")


_SQL_DAY = "coalesce(try_strptime(substr(expression, 1, 10), '%Y-%m-%d'), CASE WHEN regexp_matches(expression, '^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$') THEN try_strptime(expression, '%d.%m.%Y') END, CASE WHEN regexp_matches(expression, '(?i)^[a-z]{3,}') THEN try_strptime(regexp_replace(regexp_replace(expression, '([0-9])(?:st|nd|rd|th)', '\\1', 'g'), '[,.]', '', 'g'), '%B %d %Y') END)"


@register(f"SELECT doc_id, expression, CAST({_SQL_DAY} AS DATE) AS day FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{capture.DATES}', 1)) AS expression FROM documents)")
def q_dates(spark, folder):
    found = _docs(spark, folder).select("doc_id", F.explode_outer(capture.dates(F.col("text"))).alias("expression")).where("expression is not null")
    return found.withColumn("day", capture.resolved_date(F.col("expression")))


# --- dictionaries ------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary entries from the part names and benchmark items: their first word and first two words."""
    first = stats.words(F.col("text"))
    items = _t(spark, folder, "benchmark").select("item_id", F.explode(F.array(F.get(first, F.lit(0)), F.array_join(F.slice(first, 1, 2), " "))).alias("entry")).where("entry is not null")
    return items.groupBy("entry").agg(F.concat(F.lit("item-"), F.min("item_id").cast("string")).alias("target_uid"))


_SQL_ENTRIES = "(SELECT entry, 'item-' || CAST(min(item_id) AS VARCHAR) AS target_uid FROM (SELECT item_id, w[1] AS entry FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark) UNION ALL SELECT item_id, array_to_string(w[1:2], ' ') FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark)) WHERE entry IS NOT NULL AND entry <> '' GROUP BY entry)"


@register(f"SELECT w.doc_id, e.entry AS gram, e.target_uid, CAST(count(*) AS BIGINT) AS n FROM {_SQL_WORDS} w JOIN (SELECT * FROM {_SQL_ENTRIES} WHERE NOT contains(entry, ' ')) e ON w.term = e.entry GROUP BY ALL")
def q_spot_words(spark, folder):
    entries = spot.dictionary(_entries(spark, folder), ignore_numeric=False).where("n_words = 1")
    return spot.link_entities(_docs(spark, folder), entries, ("target_uid",)).groupBy("doc_id", "gram", "target_uid").agg(F.count("*").alias("n"))


#: The words of documents with their entries: of overlapping ones the first, then the longer. Where pairs of words that are
#: entries follow one another without a gap, every second of them counts, from the first on.
_SQL_CAPTURED = f"""e AS (SELECT * FROM {_SQL_ENTRIES} WHERE NOT regexp_matches(entry, '^[0-9 ]+$')),
w AS (SELECT doc_id, ix, term, lead(term) OVER (PARTITION BY doc_id ORDER BY ix) AS following FROM {_SQL_WORDS}),
m AS (SELECT w.*, two.target_uid AS uid_2, one.target_uid AS uid_1, two.entry IS NOT NULL AS pair FROM w LEFT JOIN e two ON two.entry = w.term || ' ' || w.following LEFT JOIN e one ON one.entry = w.term),
r AS (SELECT *, ix - row_number() OVER (PARTITION BY doc_id, pair ORDER BY ix) AS run FROM m),
k AS (SELECT *, pair AND row_number() OVER (PARTITION BY doc_id, pair, run ORDER BY ix) % 2 = 1 AS takes FROM r),
c AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY ix), false) AS covered FROM k),
captured AS (SELECT doc_id, ix, CASE WHEN takes THEN ix + 1 ELSE ix END AS last, CASE WHEN takes THEN term || ' ' || following ELSE term END AS value, CASE WHEN takes THEN uid_2 ELSE uid_1 END AS uid FROM c WHERE NOT covered)"""


@register(f"WITH {_SQL_CAPTURED} SELECT value AS gram, uid AS target_uid, CAST(count(*) AS BIGINT) AS n_mentions, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM captured WHERE uid IS NOT NULL GROUP BY ALL")
def q_linked_entities(spark, folder):
    entries = spot.dictionary(_entries(spark, folder))
    return spot.link_entities(_docs(spark, folder), entries, ("target_uid",)).groupBy("gram", "target_uid").agg(F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"))


def _with_ranges(spark, folder) -> DataFrame:
    """``doc_id, values, ranges``: the words of each document, and the dictionary's entries in them."""
    entries = spot.dictionary(_entries(spark, folder))
    found = spot.link_entities(_docs(spark, folder), entries, ("target_uid",))
    span = F.struct(F.col("at").cast("int").alias("first"), (F.col("at") + F.col("n") - 1).cast("int").alias("last"), F.col("target_uid").alias("entity_type"))
    of_doc = found.groupBy("doc_id").agg(F.collect_list(span).alias("ranges"))
    # texts are joined, as their words take several times the room in a shuffle
    return _docs(spark, folder).select("doc_id", "text").join(of_doc, "doc_id", "left").select("doc_id", stats.words(F.col("text")).alias("values"), "ranges")


@register(f"""WITH {_SQL_CAPTURED} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, CAST(count(uid) AS BIGINT) AS n_entities, sha256(string_agg(replace(value, ' ', '_'), ' ' ORDER BY ix)) AS joined FROM captured GROUP BY doc_id""")
def q_merged_tokens(spark, folder):
    """The stream of words and entities: entities in place of their words, joined by underscores."""
    items = merging.merged(F.col("values"), F.col("ranges"), merging.underscored)
    made = _with_ranges(spark, folder).select("doc_id", items.alias("items")).where(F.size("items") > 0)
    n_entities = F.size(F.filter("items", lambda x: x["entity_type"].isNotNull()))
    return made.select("doc_id", F.size("items").cast("long").alias("n_items"), n_entities.cast("long").alias("n_entities"), _sha(merging.joined_value(F.col("items"))).alias("joined"))


_SQL_UNITED = f"{_SQL_CAPTURED}, united AS (SELECT doc_id, ix AS first, ix AS last, term, false AS merged FROM c UNION ALL SELECT doc_id, ix, last, value, true FROM captured WHERE uid IS NOT NULL)"


@register(f"WITH {_SQL_UNITED} SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM united GROUP BY term")
def q_united_frequency(spark, folder):
    return merging.united_frequency(merging.united_terms(_with_ranges(spark, folder)))


@register(f"""WITH {_SQL_UNITED}, tf AS (SELECT doc_id, term, count(*) AS tf FROM united GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, term, CAST(round((1 + log10(tf)) * ln(n.n / (1 + df)) * 1000000) AS BIGINT) AS micro FROM tf JOIN df USING (term), n),
each AS (SELECT doc_id, unnest(CASE WHEN merged THEN range(first, last + 1) ELSE [first] END) AS ix, merged, micro FROM united JOIN s USING (doc_id, term))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(micro) AS BIGINT) AS total, max(micro) AS most FROM (SELECT doc_id, ix, micro, row_number() OVER (PARTITION BY doc_id, ix ORDER BY merged DESC) AS k FROM each) WHERE k = 1 GROUP BY doc_id""")
def q_tfidf_write_back(spark, folder):
    """Each word's weight in its document, that of the entity where it is in one; in millionths."""
    held = _with_ranges(spark, folder)
    made = merging.write_back(merging.united_terms(held), _docs(spark, folder).count())
    micro = F.transform("frequencies", lambda x: F.round(x * 1_000_000).cast("long"))
    return made.select("doc_id", micro.alias("m")).select("doc_id", F.size("m").cast("long").alias("n_tokens"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("m").alias("most"))


@register(f"SELECT term, CAST(count(*) AS BIGINT) AS n FROM {_SQL_WORDS} w WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark) b WHERE b.t = w.term) GROUP BY term")
def q_stop_word_anti(spark, folder):
    common = stats.exploded_words(_t(spark, folder, "benchmark"), "item_id").select("term").distinct()
    return spot.without_stop_words(stats.exploded_words(_docs(spark, folder)), common).groupBy("term").agg(F.count("*").alias("n"))


@register(f"SELECT term, CAST(count(*) AS BIGINT) AS n FROM {_SQL_WORDS} w WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark) b WHERE b.t = w.term) GROUP BY term")
def q_semi_dictionary(spark, folder):
    known = stats.exploded_words(_t(spark, folder, "benchmark"), "item_id").select("term").distinct()
    return spot.in_dictionary(stats.exploded_words(_docs(spark, folder)), known).groupBy("term").agg(F.count("*").alias("n"))


@register(f"SELECT w.term, coalesce(l.lemma, w.term) AS lemma, CAST(count(*) AS BIGINT) AS n FROM {_SQL_WORDS} w LEFT JOIN (SELECT DISTINCT term AS word, substr(term, 1, length(term) - 2) AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) WHERE length(term) > 4 AND term LIKE '%ed') l ON w.term = l.word GROUP BY ALL")
def q_lemma_lookup(spark, folder):
    known = stats.exploded_words(_t(spark, folder, "benchmark"), "item_id").where((F.length("term") > 4) & F.col("term").endswith("ed"))
    lemma_table = known.select(F.col("term").alias("word"), F.substring(F.col("term"), F.lit(1), F.length("term") - 2).alias("lemma")).distinct()
    counted = stats.exploded_words(_docs(spark, folder)).groupBy("term").agg(F.count("*").alias("n"))
    return spot.lemmas(counted, lemma_table).select("term", "lemma", "n")


# --- statistics --------------------------------------------------------------------------------------------------


@register(f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM {_SQL_WORDS} GROUP BY term")
def q_document_frequency(spark, folder):
    return stats.document_frequency(stats.exploded_words(_docs(spark, folder)))


@register(f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM {_SQL_WORDS} GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, round((1 + log10(tf)) * ln(n.n / (1 + df)), 6) AS score FROM tf JOIN df USING (term), n)
SELECT doc_id, term, tf, df, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 5""")
def q_tfidf_top(spark, folder):
    docs = _docs(spark, folder)
    scored = stats.tf_idf(stats.exploded_words(docs), docs.count()).withColumn("score", F.round("score", 6))
    return stats.top_per(scored, "doc_id", 5, F.desc("score"), F.asc("term")).withColumn("rank", F.col("rank").cast("long"))


@register(f"SELECT term, CAST(count(*) AS BIGINT) AS n FROM {_SQL_WORDS} GROUP BY term HAVING count(*) >= 5")
def q_vocabulary(spark, folder):
    return stats.vocabulary(stats.exploded_words(_docs(spark, folder)), 5)


@register(f"SELECT term, min(lang) AS lang, CAST(count(*) AS BIGINT) AS n FROM {_SQL_WORDS} GROUP BY term HAVING count(*) > 20 AND min(lang) = max(lang)")
def q_single_language_terms(spark, folder):
    return stats.single_tag_terms(stats.exploded_words(_docs(spark, folder), "doc_id", "text", "lang"), "lang", 20)


@register("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), t AS (SELECT sum(len(w)) AS t FROM w),
g AS (SELECT array_to_string(w[i:i + 1], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT array_to_string(w[i:i + 2], ' ') FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w))
SELECT gram, CAST(count(*) AS BIGINT) AS n FROM g, t GROUP BY gram, t.t HAVING count(*) BETWEEN greatest(2, floor(0.00001 * t.t)) AND floor(0.1 * t.t)""")
def q_collocations(spark, folder):
    return stats.collocations(_docs(spark, folder), 3)


@register("""WITH s AS (SELECT doc_id, least(1.0, length(text) / 4000.0) AS score FROM documents), c AS (SELECT unnest([0.40::DOUBLE, 0.45::DOUBLE, 0.50::DOUBLE, 0.55::DOUBLE, 0.59::DOUBLE]) AS cutoff), x AS (SELECT cutoff, CASE WHEN score >= cutoff THEN 1 ELSE 0 END AS p, quality AS y FROM s JOIN labels USING (doc_id), c)
SELECT cutoff, CAST(sum(p * y) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS positive, CAST(sum(y) AS BIGINT) AS actual, round(sum(p * y) / sum(p), 6) AS "precision", round(sum(p * y) / sum(y), 6) AS recall FROM x GROUP BY cutoff""")
def q_precision_recall(spark, folder):
    scored = _docs(spark, folder).select("doc_id", F.least(F.lit(1.0), F.length("text") / 4000.0).alias("score")).join(_t(spark, folder, "labels"), "doc_id")
    got = stats.precision_recall(scored, "score", "quality", [0.40, 0.45, 0.50, 0.55, 0.59])
    return got.select("cutoff", "tp", "positive", "actual", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("SELECT lang, source, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY ROLLUP (lang, source)")
def q_rollup_profile(spark, folder):
    return _docs(spark, folder).rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text").cast("long")).alias("n_chars"))


# --- language and vectors ----------------------------------------------------------------------------------------

_SQL_NORMAL = "(SELECT doc_id, lang, ' ' || trim(regexp_replace(regexp_replace(lower(text), '\\S*(?:://|@)\\S*|\\S*[0-9]\\S*', ' ', 'g'), '[^\\pL]+', ' ', 'g')) || ' ' AS t FROM documents)"


@register(f"SELECT lang, gram, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, substr(t, i, 3) AS gram FROM (SELECT lang, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM {_SQL_NORMAL})) WHERE trim(gram) <> '' GROUP BY ALL")
def q_char_trigrams(spark, folder):
    return langid.gram_counts(_docs(spark, folder), "lang", sizes=(3,))


@register(f"""WITH g AS (SELECT doc_id, lang, substr(t, i, 3) AS gram FROM (SELECT doc_id, lang, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM {_SQL_NORMAL})), c AS (SELECT doc_id, lang, gram, count(*) AS n FROM g WHERE trim(gram) <> '' GROUP BY ALL),
k AS (SELECT lang, gram, length(gram) AS s, sum(n) AS n FROM c GROUP BY lang, gram), tot AS (SELECT lang, s, sum(n) AS t FROM k GROUP BY lang, s), p AS (SELECT k.lang, gram, k.n / tot.t AS p FROM k JOIN tot ON k.lang = tot.lang AND k.s = tot.s WHERE k.n >= 5),
grams AS (SELECT DISTINCT gram FROM p), langs AS (SELECT DISTINCT lang FROM p), full_p AS (SELECT langs.lang, grams.gram, coalesce(p.p, 0.0) AS p FROM grams CROSS JOIN langs LEFT JOIN p ON p.gram = grams.gram AND p.lang = langs.lang),
s AS (SELECT c.doc_id, f.lang, sum(c.n * ln(f.p + 0.00005)) AS lp FROM c JOIN full_p f USING (gram) GROUP BY ALL) SELECT d.doc_id, coalesce(b.lang, 'und') AS lang FROM documents d LEFT JOIN (SELECT doc_id, arg_max(lang, lp) AS lang FROM s GROUP BY doc_id) b USING (doc_id)""")
def q_language_bayes(spark, folder):
    docs = _docs(spark, folder)
    return langid.detect(docs, langid.fit_profiles(docs, sizes=(3,)), sizes=(3,)).select("doc_id", "lang")


@register()
def q_language_linear(spark, folder):
    docs = _docs(spark, folder)
    model = langid.fit_linear_detector(docs)
    return model.transform(docs.withColumn("_label", F.lit(0.0))).select("doc_id", F.col("prediction_lang").alias("lang_pred"))


@register("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, v.vec_id, round(list_cosine_similarity(q.q::DOUBLE[], v.embedding::DOUBLE[]), 4) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.q::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM q JOIN embeddings v ON v.vec_id <> q.query_id) SELECT query_id, vec_id, cosine, CAST(rank AS BIGINT) AS rank FROM s WHERE rank <= 10""")
def q_most_similar(spark, folder):
    all_ = _t(spark, folder, "embeddings")
    got = vectors.most_similar(all_.where("vec_id % 100 = 0"), all_, 10)
    return got.select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@register("SELECT label, CAST(i - 1 AS BIGINT) AS ix, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL")
def q_centroids(spark, folder):
    return vectors.centroids(_t(spark, folder, "embeddings"), "label").select("label", F.col("ix").cast("long").alias("ix"), F.round("mean", 6).alias("mean"))


@register()
def q_topics(spark, folder):
    docs = _docs(spark, folder).select("doc_id", vectors.topic_words(stats.words(F.col("text"))).alias("words"))
    model = vectors.fit_topics(docs)
    return vectors.describe_topics(model)


@register()
def q_classifier(spark, folder):
    docs = _docs(spark, folder).join(_t(spark, folder, "labels"), "doc_id", "left").select("doc_id", F.col("toxic").cast("double").alias("label"), stats.words(F.col("text")).alias("words"))
    model = vectors.fit_classifier(docs.where("label is not null"), "label")
    return model.transform(docs).select("doc_id", "label", "prediction")


# --- documents, weights and sets ---------------------------------------------------------------------------------


@register("SELECT doc_id, sha256(text) AS back FROM documents")
def q_json_round_trip(spark, folder):
    made = _docs(spark, folder).select(readers.to_json(_docs(spark, folder).select("doc_id", "lang", "text")).alias("json"))
    return readers.from_json(made).select("doc_id", _sha(F.col("text")).alias("back"))


@register()
def q_html_text(spark, folder):
    return _t(spark, folder, "pages").select("page_id", _sha(normalize.html_to_text(F.col("html"))).alias("read"))


_SQL_MARKED = "regexp_replace(regexp_replace(regexp_replace(text, '\\b(Dr|Mr|Mrs|Ms|Prof|St|Jr|Sr|vs|etc|e\\.g|i\\.e|No|Nr|Co|Inc|Ltd|M|Mme|z\\.B|Sra)\\.', '\\1' || chr(3), 'g'), '([.!?…]+[\"''”’)\\]]*)\\s+([^\\p{Ll}\\s])', '\\1' || chr(2) || '\\2', 'g'), '\\n+', chr(2), 'g')"


@register(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS ix, sha256(sentence) AS sentence FROM (SELECT doc_id, i, trim(s[i]) AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(replace({_SQL_MARKED}, chr(3), '.'), chr(2)) AS s FROM documents))) WHERE sentence <> ''")
def q_sentences(spark, folder):
    found = _docs(spark, folder).select("doc_id", F.posexplode_outer(sentences.sentence_texts(F.col("text"))).alias("ix", "sentence")).where("sentence is not null")
    return found.select("doc_id", F.col("ix").cast("long").alias("ix"), _sha(F.col("sentence")).alias("sentence"))


@register(f"SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 1 ELSE 0 END) AS BIGINT) AS n_numbers FROM (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: NOT regexp_matches(x, '^\\s*$'))) AS x FROM documents) GROUP BY doc_id HAVING n_numbers > 0")
def q_number_tokens(spark, folder):
    put = normalize.number_to_word(tokenize.space_tokens(F.col("text")))
    counted = _docs(spark, folder).select("doc_id", F.size(F.filter(put, lambda t: t["replacement"].isNotNull())).cast("long").alias("n_numbers"))
    return counted.where("n_numbers > 0")


@register(f"WITH v AS (SELECT term, count(*) AS n FROM {_SQL_WORDS} GROUP BY term HAVING count(*) >= 5) SELECT term, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM v), 9) AS p FROM v")
def q_negative_sampling(spark, folder):
    return stats.negative_sampling(stats.vocabulary(stats.exploded_words(_docs(spark, folder)), 5)).select("term", F.round("p", 9).alias("p"))


@register(f"WITH v AS (SELECT term, count(*) AS n FROM {_SQL_WORDS} GROUP BY term), t AS (SELECT sum(n) AS t FROM v) SELECT term, round(greatest(0.0, 1 - sqrt(0.0001 / (n / t.t))), 6) AS p FROM v, t")
def q_discard_probability(spark, folder):
    counted = stats.vocabulary(stats.exploded_words(_docs(spark, folder)), 1)
    total = counted.agg(F.sum("n")).first()[0] or 1
    return counted.select("term", F.round(stats.discard_probability(F.col("n") / total), 6).alias("p"))


@register("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS signs FROM embeddings")
def q_quantised(spark, folder):
    signs = F.transform(vectors.quantise(F.col("embedding")), lambda x: F.when(x > 0, "1").otherwise("0"))
    return _t(spark, folder, "embeddings").select("vec_id", F.array_join(signs, "").alias("signs"))


@register("SELECT lang, source FROM documents WHERE length(text) > 10000 INTERSECT SELECT lang, source FROM documents WHERE length(text) < 100")
def q_set_intersection(spark, folder):
    docs = _docs(spark, folder)
    return docs.where(F.length("text") > 10000).select("lang", "source").intersect(docs.where(F.length("text") < 100).select("lang", "source"))


@register()
def q_pipeline_annotations(spark, folder):
    made = plans.Pipeline.for_many(["en", "de", "fr", "es"]).add(plans.personal_data(None, ["EMAIL_ADDRESS", "IP_ADDRESS"])).transform(_docs(spark, folder))
    # findings stand first, so that Spark has them found before there are tokens, which else wait beside the texts meanwhile
    return made.select("lang", "findings", "tokens").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("tokens")).alias("n_tokens"), F.sum(F.size("findings")).alias("n_findings"))


# --- pipelines and edits -----------------------------------------------------------------------------------------

_SQL_SPACED = "(SELECT doc_id, list_filter(string_split(text, ' '), lambda x: NOT regexp_matches(x, '^\\s*$')) AS w FROM documents)"


@register("""WITH p AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))),
t AS (SELECT doc_id, x, i, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1 AS b FROM p), k AS (SELECT doc_id, x, b, b + length(x) - 1 AS e, lead(x) OVER win AS next, lag(x) OVER win AS previous FROM t WHERE NOT regexp_matches(x, '^\\s*$') WINDOW win AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, next IS NULL OR (regexp_matches(x, '[.!?…]["''”’)\\]]*$') AND NOT regexp_matches(next, '^\\p{Ll}')) AS ends, previous IS NULL OR (regexp_matches(previous, '[.!?…]["''”’)\\]]*$') AND NOT regexp_matches(x, '^\\p{Ll}')) AS begins FROM k)
SELECT doc_id, CAST(count(*) FILTER (ends) AS BIGINT) AS n_sentences, CAST(sum(b) FILTER (begins) AS BIGINT) AS sum_begin, CAST(sum(e) FILTER (ends) AS BIGINT) AS sum_end FROM m GROUP BY doc_id""")
def q_sentence_spans(spark, folder):
    """The spans of a pipeline of tokens by blanks and sentences by rule."""
    made = plans.Pipeline().add(plans.space_tokenizer()).add(plans.rule_sentences()).transform(_docs(spark, folder))
    total = lambda name: F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[name])
    return made.where(F.size("spans") > 0).select("doc_id", F.size("spans").cast("long").alias("n_sentences"), total("begin").alias("sum_begin"), total("end").alias("sum_end"))


@register("SELECT doc_id, sha256(regexp_replace(text, '[0-9]+', '<N>', 'g')) AS put FROM documents")
def q_replace_numbers(spark, folder):
    """Spans of digits replaced from the right."""
    parts = F.regexp_extract_all(F.col("text"), F.lit("([0-9]+|[^0-9]+)"), 1)
    at = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when(p.rlike("^[0-9]"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p) - 1).alias("end")))).otherwise(acc["out"]).alias("out")))
    return _docs(spark, folder).select("doc_id", _sha(tokenize.replace_spans(F.col("text"), at["out"], lambda s: F.lit("<N>"))).alias("put"))


@register(f"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[-–—~]+$') THEN '-' WHEN regexp_matches(x, '^{_W}(?:{_H}{_W})+$') THEN regexp_replace(x, '{_H}', '_', 'g') WHEN regexp_matches(x, '\\pP') THEN '' ELSE x END), lambda x: x <> ''), ' ')) AS plain FROM {_SQL_SPACED}")
def q_remove_punctuation(spark, folder):
    put = normalize.with_replacements(normalize.remove_punctuation(tokenize.space_tokens(F.col("text"))))
    return _docs(spark, folder).select("doc_id", _sha(tokenize.tokenized_value(put)).alias("plain"))


@register(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS ix, w[i] AS value, CASE WHEN i > 1 THEN ' ' WHEN starts_with(text, ' ') THEN ' ' END AS previous_char, CASE WHEN i < len(w) THEN ' ' WHEN ends_with(text, ' ') THEN ' ' END AS next_char FROM (SELECT doc_id, text, w, unnest(range(1, len(w) + 1)) AS i FROM {_SQL_SPACED} JOIN documents USING (doc_id))")
def q_neighbour_characters(spark, folder):
    each = _docs(spark, folder).select("doc_id", "text", tokenize.space_tokens(F.col("text")).alias("tokens"))
    near = each.select("doc_id", F.inline_outer(tokenize.with_neighbours(F.col("tokens"), F.col("text")))).where("value is not null")
    return near.select("doc_id", F.col("ix").cast("long").alias("ix"), "value", "previous_char", "next_char")


_MORE_PREDICATES = {
    "blank": (chars.is_blank, "regexp_matches(x, '^\\s*$')"),
    "currency": (chars.is_currency, "regexp_matches(x, '^\\p{Sc}+$')"),
    "quote": (chars.is_quote, "regexp_matches(x, '^[\"''`‘“«‹„‚’”»›]+$')"),
    "open_quote": (chars.is_open_quote, "regexp_matches(x, '^[\"''`‘“«‹„‚]+$')"),
    "local_part": (chars.is_email_local_part, "regexp_matches(x, '^[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]+$')"),
    "mail_domain": (chars.is_email_domain, "regexp_matches(x, '^[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+$')"),
    "url_or_email": (chars.like_url_or_email, f"regexp_matches(x, '{chars.URL_OR_EMAIL}')"),
    "url": (chars.like_url, f"regexp_matches(x, '{chars.URL_OR_EMAIL}') AND NOT regexp_matches(x, '{chars.EMAIL}')"),
    "emoji": (chars.is_emoji, "regexp_matches(x, '^[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]+$')"),
}


@register("SELECT doc_id, " + ", ".join(f"CAST(sum(CASE WHEN {sql} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, (_, sql) in _MORE_PREDICATES.items()) + f" FROM (SELECT doc_id, unnest(string_split(text || '{_RARE}', ' ')) AS x FROM documents) GROUP BY doc_id")
def q_more_predicates(spark, folder):
    pieces = _docs(spark, folder).select("doc_id", F.explode_outer(F.split(F.concat("text", F.lit(_RARE)), " ")).alias("x")).where("x is not null")
    return pieces.groupBy("doc_id").agg(*[F.sum(f(F.col("x")).cast("long")).alias(name) for name, (f, _) in _MORE_PREDICATES.items()])


#: Numbers of kinds that the tables lack, put after each text.
_RARE_NUMBERS = " 417-20-8835 48213907K T5730218C 10.20.30.40 (417) 555-0138"


def _kinds(spark, folder, wanted: list[pii.Recognizer]):
    found = pii.Analyzer("en", wanted).analyze(_docs(spark, folder).withColumn("text", F.concat("text", F.lit(_RARE_NUMBERS))))
    each = found.select("doc_id", "text", F.explode_outer("findings").alias("f")).where("f is not null")
    return each.select("doc_id", "f.entity_type", F.substring("text", F.col("f.start") + 1, F.col("f.end") - F.col("f.start") + 1).alias("found")).groupBy("entity_type", "doc_id", "found").agg(F.count("*").alias("n"))


#: Kinds whose pattern is one token of a shape, and how SQL sees them between what tokens end at.
_SHAPED = {"IP_ADDRESS": "(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})[.]){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})", "US_SSN": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "PHONE_US": "(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[(][0-9]{3}[)] +[0-9]{3}-[0-9]{4})", "ES_NIF": "(?:[0-9]{8}\\p{Lu}|\\p{Lu}[0-9]{7}\\p{Lu})", "SG_NRIC_FIN": "\\p{Lu}[0-9]{7}\\p{Lu}"}


@register(" UNION ALL ".join(f"SELECT '{kind}' AS entity_type, doc_id, replace(found, '  ', ' ') AS found, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text || '{_RARE_NUMBERS}', '(\\s)', '\\1\\1', 'g'), '(?:^|[\\s(\"''])({pattern})(?:[.,;:!?)\"''#*%&$]*(?:\\s|$))', 1)) AS found FROM documents) GROUP BY ALL" for kind, pattern in _SHAPED.items()))
def q_shaped_findings(spark, folder):
    return _kinds(spark, folder, [r for r in pii.ALL if r.entity_type in _SHAPED])


@register(f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM {_SQL_WORDS} GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(max((1 + log10(tf)) * ln(n.n / (1 + df))), 6) AS best FROM tf JOIN df USING (term), n WHERE df > floor(0.01 * n.n) GROUP BY doc_id""")
def q_tfidf_pruned(spark, folder):
    docs = _docs(spark, folder)
    return stats.tf_idf(stats.exploded_words(docs), docs.count(), 0.01).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("score"), 6).alias("best"))


@register(f"SELECT shape, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list(term ORDER BY term)[1:50]), ' ') AS examples FROM (SELECT term, n, {_SQL_SHAPE.replace('(x,', '(term,')} AS shape FROM (SELECT term, count(*) AS n FROM {_SQL_WORDS} GROUP BY term)) GROUP BY shape")
def q_shape_examples(spark, folder):
    got = stats.shape_histogram(stats.exploded_words(_docs(spark, folder)))
    return got.select("shape", "n", F.array_join("examples", " ").alias("examples"))


@register(f"SELECT w.doc_id, coalesce(b.spelling, w.term) AS term, CAST(count(*) AS BIGINT) AS n FROM {_SQL_WORDS} w LEFT JOIN (SELECT DISTINCT term AS word, replace(term, 'ou', 'o') AS spelling FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) WHERE contains(term, 'ou')) b ON b.word = w.term GROUP BY ALL")
def q_spelling_map(spark, folder):
    known = stats.exploded_words(_t(spark, folder, "benchmark"), "item_id").where(F.col("term").contains("ou")).select(F.col("term").alias("word")).distinct()
    put = normalize.map_spelling(stats.exploded_words(_docs(spark, folder)), known.withColumn("spelling", F.replace("word", F.lit("ou"), F.lit("o"))))
    return put.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@register("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def q_appears_in(spark, folder):
    """Benchmark items in documents, wherever they begin and end."""
    return stats.appearances(_docs(spark, folder), _t(spark, folder, "benchmark")).select("doc_id", "item_id")


@register("SELECT doc_id, sha256(text) AS whole, regexp_matches(lower(text), '(?s)a.*e.*i.*o') AS has_letters FROM documents")
def q_sub_sequence(spark, folder):
    return _docs(spark, folder).select("doc_id", _sha(F.col("text")).alias("whole"), text.is_sub_sequence(F.lit("aeio"), F.lower("text")).alias("has_letters"))


@register("SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, source FROM documents WHERE length(text) > 10000 UNION ALL SELECT lang, source FROM documents WHERE length(text) < 100) GROUP BY ALL")
def q_union(spark, folder):
    docs = _docs(spark, folder)
    return docs.where(F.length("text") > 10000).select("lang", "source").unionByName(docs.where(F.length("text") < 100).select("lang", "source")).groupBy("lang", "source").agg(F.count("*").alias("n"))


@register("SELECT DISTINCT lang, source FROM documents EXCEPT SELECT lang, source FROM documents WHERE length(text) > 5000")
def q_set_difference(spark, folder):
    docs = _docs(spark, folder)
    return docs.select("lang", "source").distinct().exceptAll(docs.where(F.length("text") > 5000).select("lang", "source").distinct())


@register("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round((x / m + 1) / 2 * 3) AS INTEGER)), '') AS levels FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding, greatest(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 1e-12) AS m FROM embeddings)")
def q_quantised_two_bits(spark, folder):
    vec = F.transform("embedding", lambda x: x.cast("double"))
    top = F.array_max(F.transform(vec, lambda x: F.abs(x)))
    level = F.transform(vectors.quantise(vec, 2), lambda x: F.round((x / top + 1) / 2 * 3).cast("int").cast("string"))
    return _t(spark, folder, "embeddings").select("vec_id", F.array_join(level, "").alias("levels"))


@register(f"WITH v AS (SELECT term, count(*) AS n FROM {_SQL_WORDS} GROUP BY term HAVING count(*) >= 5) SELECT term, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, term) AS BIGINT) AS rank FROM v QUALIFY rank <= 500")
def q_vocabulary_order(spark, folder):
    """The 500 most frequent terms in their order: the report is the feature."""
    return stats.most_frequent(stats.vocabulary(stats.exploded_words(_docs(spark, folder)), 5), 500)


@register(f"WITH g AS (SELECT lang, term, count(*) AS n FROM {_SQL_WORDS} GROUP BY ALL) SELECT lang, term, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM g) WHERE rank <= 20")
def q_top_terms_by_language(spark, folder):
    counted = stats.exploded_words(_docs(spark, folder), "doc_id", "text", "lang").groupBy("lang", "term").agg(F.count("*").alias("n"))
    return stats.top_per(counted, "lang", 20, F.desc("n"), F.asc("term")).withColumn("rank", F.col("rank").cast("long"))


# --- events ------------------------------------------------------------------------------------------------------


@register("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_event_windows(spark, folder):
    got = _t(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Clean, find personal data, mask it and count by language."""
    docs = _docs(spark, folder).withColumn("text", text.clean_text(F.col("text")))
    found = pii.Analyzer("en").add_all().analyze(docs)
    masked = pii.anonymize(F.col("text"), F.col("findings"))
    return found.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("findings")).alias("n_findings"), F.sum((masked != F.col("text")).cast("long")).alias("n_masked"))

