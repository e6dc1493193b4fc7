"""Pipelines of annotators: stages in their canonical order, each a function from DataFrame to DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import capture, merging, patterns, perceptron, pii, sentences, spot, tokenize
from textloom.operators.perceptron import Weights
from textloom.schema import FINDING

#: Columns that stages read.
READ = ("text", "tokens", "spans", "tags")
#: Kinds of stage in the order in which they run.
KINDS = ("normalizer", "tokenizer", "token_normalizer", "sentence", "tagger", "other", "correction")


@dataclass(frozen=True)
class Stage:
    """What a stage does to the documents of its language (``None``: of any)."""

    name: str
    kind: str
    apply: Callable[[DataFrame], DataFrame]
    lang: str | None = None
    options: dict = field(default_factory=dict)
    entity_types: tuple[str, ...] = ()
    special_cases: tuple[str, ...] = ()
    models: dict[str, Weights] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Documents of other languages keep their columns as they were; new columns are null for them. What the stage
        reads is null there too, so its functions do no work on them."""
        if self.lang is None or "lang" not in df.columns:
            return self.apply(df)
        mine = F.col("lang").isNull() | (F.col("lang") == self.lang)
        held = df.withColumns({f"_was_{c}": F.col(c) for c in df.columns} | {c: F.when(mine, F.col(c)) for c in READ if c in df.columns})
        made = self.apply(held)
        keep = [F.when(mine, F.col(c)).otherwise(F.col(f"_was_{c}")).alias(c) if c in df.columns else F.when(mine, F.col(c)).alias(c) for c in made.columns if not c.startswith("_was_")]
        return made.select(*keep)


def lower_case(lang=None) -> Stage:
    return Stage("lower_case", "normalizer", lambda df: df.withColumn("text", T.lower_case(F.col("text"))), lang)


def upper_case(lang=None) -> Stage:
    return Stage("upper_case", "normalizer", lambda df: df.withColumn("text", T.upper_case(F.col("text"))), lang)


def clean(lang=None) -> Stage:
    return Stage("clean", "normalizer", lambda df: df.withColumn("text", T.clean_text(F.col("text"))), lang)


def fold_to_ascii(lang=None) -> Stage:
    return Stage("fold_to_ascii", "normalizer", lambda df: df.withColumn("text", T.fold_to_ascii(F.col("text"))), lang)


def fast_tokenizer(lang=None, special_cases: tuple[str, ...] = (), langs: tuple[str, ...] = (), addresses: bool = False) -> Stage:
    """With ``langs`` one pass over the documents of all these languages, each by its own exceptions. With ``addresses``
    the tokens that are URLs or mail addresses are ``entities`` too."""
    more = dict.fromkeys(special_cases)
    cut = lambda df: tokenize.fast_tokens_by_language(F.col("text"), F.col("lang"), list(langs), more) if langs else F.when(F.col("text").isNotNull(), tokenize.fast_tokens(F.col("text"), lang or "en", more))

    def apply(df: DataFrame) -> DataFrame:
        made = df.withColumn("tokens", cut(df))
        if not addresses:
            return made
        own = F.transform(F.filter("tokens", lambda t: t["kind"] == "url"), lambda t: F.struct(t["begin"].alias("start"), t["end"].alias("end"), F.lit(merging.ADDRESS).alias("entity_type"), F.lit(1.0).cast("float").alias("score")).cast(FINDING))
        return made.withColumn("entities", F.array_sort(F.array_distinct(F.concat(F.coalesce("entities", F.array().cast(f"array<{FINDING}>")), own))) if "entities" in df.columns else own)

    return Stage("fast_tokenizer", "tokenizer", apply, lang, {"special_cases": list(special_cases), "langs": list(langs), "addresses": addresses}, (merging.ADDRESS,) if addresses else ())


def merged_tokens(lang=None, col: str = "entities") -> Stage:
    """``captured``: the stream of tokens and entities, of which entities take the place of their tokens."""
    ranges = merging.token_ranges(F.col("tokens"), F.col(col))
    return Stage("merged_tokens", "correction", lambda df: df.withColumn("captured", merging.merged(F.transform("tokens", lambda t: t["value"]), ranges)), lang, {"col": col})


def space_tokenizer(lang=None) -> Stage:
    return Stage("space_tokenizer", "tokenizer", lambda df: df.withColumn("tokens", tokenize.space_tokens(F.col("text"))), lang)


def personal_data(lang=None, types: list[str] | None = None) -> Stage:
    chosen = [r for r in pii.ALL if types is None or r.entity_type in types]
    return Stage("personal_data", "other", lambda df: pii.Analyzer(lang or "en", chosen).analyze(df), lang, {"types": types}, tuple(r.entity_type for r in chosen))


def abbreviations(lang=None) -> Stage:
    return Stage("abbreviations", "other", lambda df: df.withColumn("abbreviations", capture.abbreviations(F.col("text"), lang=lang or "en")), lang)


def rule_sentences(lang=None) -> Stage:
    """``spans`` by rule, from the tokens."""
    return Stage("rule_sentences", "sentence", lambda df: df.withColumn("spans", sentences.spans_of_tokens(F.col("tokens"))), lang)


def sentence_detector(lang=None, *, model: Weights) -> Stage:
    """``spans`` by a model that ``fit_sentence_model`` gave."""
    return Stage("sentence_detector", "sentence", lambda df: df.withColumn("spans", sentences.sentence_spans(F.col("text"), model, lang or "en")), lang, models={"model": model})


def tagger(lang=None, *, model: Weights) -> Stage:
    """``tags``: the part of speech of each token."""
    return Stage("tagger", "tagger", lambda df: perceptron.tag_documents(df, model), lang, models={"model": model})


def entity_tagger(lang=None, *, model: Weights, gazetteer: DataFrame | None = None) -> Stage:
    """``entities`` by a model over B/I/L/O/U tags, beside those that are there. With a ``gazetteer`` (``gram, n_words,
    type``, as ``spot.dictionary`` gives it) the model sees the kinds of entry that each token is in."""

    def apply(df: DataFrame) -> DataFrame:
        found = patterns.entities_of_tags(F.col("tokens"), F.col("_entity_tags"))
        if gazetteer is None:
            held = perceptron.tag_documents(df, model, "_entity_tags", entities=True)
        else:
            listed = spot.known_types(df.withColumn("_values", F.transform("tokens", lambda t: t["value"])), gazetteer, into="_known", words_col="_values")
            held = perceptron.tag_documents(listed, model, "_entity_tags", entities=True, known_col="_known").drop("_known", "_values")
        both = F.array_sort(F.array_distinct(F.concat(F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,entity_type:string,score:float>>")), found))) if "entities" in df.columns else found
        return held.withColumn("entities", both).drop("_entity_tags")

    return Stage("entity_tagger", "other", apply, lang, entity_types=tuple(sorted({x[2:] for x in model.labels if x[1:2] == "-"})), models={"model": model})


def parser(lang=None, *, model: Weights) -> Stage:
    """``heads``: for each token its head's place, -1 for a root."""
    return Stage("parser", "other", lambda df: perceptron.parse_documents(df, model), lang, models={"model": model})


def pattern_spotter(entity_type: str, *spotted: patterns.Pattern, lang=None, into: str = "entities", special_cases: tuple[str, ...] = ()) -> Stage:
    """Entities that patterns match. Over tokens that are there already the patterns see their tags and entities too; the
    tokenizers keep ``special_cases`` whole."""
    recognizers = [patterns.Recognizer(entity_type, list(spotted))]

    def apply(df: DataFrame) -> DataFrame:
        known = F.col(into) if into in df.columns else None
        if "tokens" not in df.columns:
            return df.withColumn(into, patterns.find_entities(F.col("text"), recognizers, lang or "en"))
        more = patterns.find_in_tokens(F.col("tokens"), recognizers, F.col("tags") if "tags" in df.columns else None, known)
        return df.withColumn(into, more if known is None else F.array_sort(F.array_distinct(F.concat(F.coalesce(known, F.filter(more, lambda f: F.lit(False))), more))))

    return Stage(f"spotter_{entity_type}", "other", apply, lang, entity_types=(entity_type,), special_cases=special_cases)


def neuralyzer(forget: dict[str, list[patterns.Pattern]] | None = None, add: dict[str, list[patterns.Pattern]] | None = None, lang=None, col: str = "findings") -> Stage:
    """Corrections that run last: entities of a type are added where its patterns match, then taken away where others do.

    Over tokens that are there already nothing is cut again, and it has two phases: only documents that have a token
    which the patterns can't do without are matched.
    """
    adding = [patterns.Recognizer(t, ps) for t, ps in (add or {}).items()]
    forgetting = [patterns.Recognizer(t, ps) for t, ps in (forget or {}).items()]

    def found(df: DataFrame, recognizers: list[patterns.Recognizer]):
        none = F.filter(F.col(col), lambda f: F.lit(False))
        if not recognizers:
            return none
        if "tokens" not in df.columns:
            return patterns.find_entities(F.col("text"), recognizers, lang or "en")
        needed = patterns.literal_tokens([p for r in recognizers for p in r.patterns])
        may = F.lit(True) if needed is None else F.arrays_overlap(F.transform("tokens", lambda t: F.lower(t["value"])), F.array(*[F.lit(v) for v in sorted(needed)]).cast("array<string>"))
        return F.coalesce(patterns.find_in_tokens(F.when(may, F.col("tokens")), recognizers, F.col("tags") if "tags" in df.columns else None), none)

    def apply(df: DataFrame) -> DataFrame:
        same = lambda f: F.exists("_less", lambda x: (x["start"] == f["start"]) & (x["end"] == f["end"]) & (x["entity_type"] == f["entity_type"]))
        held = df.withColumn("_more", found(df, adding)).withColumn("_less", found(df, forgetting))
        return held.withColumn(col, F.filter(F.array_sort(F.array_distinct(F.concat(col, "_more"))), lambda f: ~same(f))).drop("_more", "_less")

    return Stage("neuralyzer", "correction", apply, lang)


@dataclass
class Corrections:
    """What was taught, by language (``None``: any) and type, to be put into any pipeline as its last stages."""

    taught: dict[str | None, dict[str, dict[str, list[patterns.Pattern]]]] = field(default_factory=dict)

    def teach(self, what: str, lang: str | None, entity_type: str, pattern: patterns.Pattern) -> Corrections:
        """``what`` is ``add`` or ``forget``."""
        if what not in ("add", "forget"):
            raise ValueError(f"can't {what}")
        self.taught.setdefault(lang, {"add": {}, "forget": {}})[what].setdefault(entity_type, []).append(pattern)
        return self

    def clear(self, lang: str | None) -> Corrections:
        self.taught.pop(lang, None)
        return self

    def applied_to(self, made: Pipeline, col: str = "findings") -> Pipeline:
        """The pipeline with these corrections and no earlier ones."""
        made = made.remove("neuralyzer")
        for lang, both in sorted(self.taught.items(), key=lambda x: x[0] or ""):
            made = made.add(neuralyzer(both["forget"], both["add"], lang, col))
        return made


#: Stages that a manifest can name.
FACTORIES = {f.__name__: f for f in (lower_case, upper_case, clean, fold_to_ascii, fast_tokenizer, space_tokenizer, personal_data, abbreviations, rule_sentences, sentence_detector, tagger, entity_tagger, parser, merged_tokens)}


@dataclass(frozen=True)
class Pipeline:
    lang: str | None = None
    stages: tuple[Stage, ...] = ()
    version: int = 0
    tag: str = ""

    @staticmethod
    def for_language(lang: str | None, sentence_model: Weights | None = None, tagger_model: Weights | None = None) -> Pipeline:
        """Cleaning, tokens and sentences (by rule without a model), and tags with a model."""
        made = Pipeline(lang).add(clean(lang)).add(fast_tokenizer(lang)).add(sentence_detector(lang, model=sentence_model) if sentence_model else rule_sentences(lang))
        return made.add(tagger(lang, model=tagger_model)) if tagger_model else made

    @staticmethod
    def for_many(langs: list[str], taggers: dict[str, Weights] | None = None) -> Pipeline:
        """One pipeline for the documents of many languages, which are tokenized in one pass."""
        made = Pipeline().add(clean()).add(fast_tokenizer(langs=tuple(langs))).add(rule_sentences())
        for lang, model in (taggers or {}).items():
            made = made.add(tagger(lang, model=model))
        return made

    @staticmethod
    def tokenizer_for(lang: str | None) -> Pipeline:
        return Pipeline(lang).add(fast_tokenizer(lang))

    def add(self, stage: Stage) -> Pipeline:
        """In the canonical order of kinds, after others of its kind; its special cases go to the tokenizers."""
        if stage.kind not in KINDS:
            raise ValueError(f"no kind {stage.kind}")
        stages = sorted([*self.stages, stage], key=lambda s: KINDS.index(s.kind))
        return replace(self, stages=tuple(stages))._with_cases({c for s in stages for c in s.special_cases})

    def _with_cases(self, cases: set[str]) -> Pipeline:
        def told(s: Stage) -> Stage:
            known = tuple(s.options.get("special_cases", ()))
            more = tuple(sorted(cases - set(known)))
            return fast_tokenizer(s.lang, known + more, tuple(s.options["langs"]), s.options["addresses"]) if s.name == "fast_tokenizer" and more else s

        return replace(self, stages=tuple(map(told, self.stages)))

    def add_to_begin(self, stage: Stage) -> Pipeline:
        return replace(self, stages=(stage, *self.stages))

    def remove(self, name: str) -> Pipeline:
        return self.remove_all(lambda s: s.name == name)

    def remove_all(self, condition: Callable[[Stage], bool]) -> Pipeline:
        return replace(self, stages=tuple(s for s in self.stages if not condition(s)))

    def replace_with(self, other: Pipeline) -> Pipeline:
        return replace(self, stages=other.stages)

    def update(self, stage: Stage) -> Pipeline:
        return replace(self, stages=tuple(stage if s.name == stage.name else s for s in self.stages))

    def has(self, name: str) -> bool:
        return any(s.name == name for s in self.stages)

    def names(self) -> list[str]:
        return [s.name for s in self.stages]

    def entity_types(self) -> list[str]:
        return sorted({t for s in self.stages for t in s.entity_types})

    def add_special_case(self, word: str) -> Pipeline:
        """The tokenizers keep this word whole."""
        return self._with_cases({word})

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df

    def pack(self, spark: SparkSession, path: str) -> None:
        """Write a manifest of the stages and their weights, as tables that every node can read."""
        for s in self.stages:
            if s.name not in FACTORIES:
                raise ValueError(f"{s.name} can't be named in a manifest")
        body = json.dumps({"lang": self.lang, "version": self.version, "tag": self.tag, "stages": [{"name": s.name, "lang": s.lang, "options": s.options, "models": sorted(s.models)} for s in self.stages]})
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        for k, s in enumerate(self.stages):
            for name, model in s.models.items():
                model.to_rows(spark).write.mode("overwrite").parquet(f"{path}/weights/{k}/{name}")

    @staticmethod
    def unpack(spark: SparkSession, path: str) -> Pipeline:
        made = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first().value)
        stages = []
        for k, s in enumerate(made["stages"]):
            models = {name: Weights.from_rows(spark.read.parquet(f"{path}/weights/{k}/{name}")) for name in s["models"]}
            stages.append(FACTORIES[s["name"]](s["lang"], **{x: tuple(v) if x in ("special_cases", "langs") else v for x, v in s["options"].items()}, **models))
        return Pipeline(made["lang"], tuple(stages), made["version"], made["tag"])


def store_model(spark: SparkSession, root: str, kind: str, lang: str, version: int, model: Weights, tag: str = "") -> None:
    """Keep weights under their kind, language, version and tag; the same ones again replace them."""
    model.to_rows(spark).write.mode("overwrite").parquet(f"{root}/kind={kind}/lang={lang}/version={version}/tag={tag or 'none'}")


def load_model(spark: SparkSession, root: str, kind: str, lang: str, version: int | None = None, tag: str = "") -> Weights:
    """The weights stored so; without a version those of the highest."""
    found = spark.read.option("basePath", root).parquet(root).where((F.col("kind") == kind) & (F.col("lang") == lang) & (F.col("tag") == (tag or "none")))
    chosen = version if version is not None else found.agg(F.max("version")).first()[0]
    rows = found.where(F.col("version") == chosen) if chosen is not None else found.limit(0)
    if rows.isEmpty():
        raise LookupError(f"no model {kind} for {lang}, version {version}, tag {tag!r}")
    return Weights.from_rows(rows.select("feature", "label", "weight"))
