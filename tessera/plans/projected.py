"""Registered queries, continued: cards and queries projected from other records, labels, repairs of texts, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X
from tessera.operators import assembly, compositions, diagnostics, interpretations, projections, representations, retrieval, rules
from tessera.plans.catalogue import CATALOGUE, query, table, vector_queries
from tessera.sources import files, sinks

# ---------------------------------------------------------------- references and labels

#: Work, place and author by the remainder of an id, with the reference and the label that readers see; # is the id.
PLACES = [
    ("Тора", "Чис #:10–17", None, "Ветхий Завет, Числа #:10–17", "Тора · Чис #:10–17"), ("Бхагавад-гита", "БГ 4.#", None, "Бхагавад-гита, 4.#", "Бхагавад-гита · БГ 4.#"),
    ("Дао дэ цзин", "Чжан #", None, "Дао дэ цзин, глава #", "Дао дэ цзин · глава #"), ("Дхаммапада", "#–#", None, "Дхаммапада, стихи #–#", "Дхаммапада · стихи #–#"), ("Беседы", "I.#", None, "Эпиктет, Беседы, I.#", "Эпиктет · Беседы · I.#"),
    ("Work #", "", "Author", "Author, Work #", "Author · Work #"), ("Евангелия", "Мф #:3", "Иисус", "Новый Завет, Матфея #:3", "Новый Завет · От Матфея #:3"), ("Менон", "#d", "Сократ", "Сократ, Менон, #d", "Платон · Менон · #d"),
    ("Same #", "Same #", "A; B", "A; B, Same #, Same #", "A · Same #"),
]


def placed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    k, number = (F.col("doc_id") % len(PLACES)).cast("int"), F.col("doc_id").cast("string")
    cell = lambda n: F.replace(F.get(F.array(*[F.lit(p[n]).cast("string") for p in PLACES]), k), F.lit("#"), number)
    return d.select("doc_id", cell(0).alias("work"), cell(1).alias("location"), cell(2).alias("author"))


@query("WITH p(k, reference, label) AS (VALUES " + ", ".join(f"({k}, '{p[3]}', '{p[4]}')" for k, p in enumerate(PLACES)) + f") SELECT doc_id, replace(reference, '#', doc_id::VARCHAR) AS reference, replace(label, '#', doc_id::VARCHAR) AS label FROM documents JOIN p ON doc_id % {len(PLACES)} = k")
def reader_references(spark, sf_dir):
    """How readers know a place, and display labels with each part once."""
    return placed(spark, sf_dir).select("doc_id", projections.display_reference("work", "location", "author").alias("reference"), projections.display_label("work", "location", "author").alias("label"))


@query("SELECT doc_id, array_to_string(list_filter([nullif(trim(source), ''), CASE WHEN doc_id % 2 = 0 THEN lang END], lambda x: x IS NOT NULL), ', ') AS source_label, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 39)) || '…' ELSE text END AS shown, 'Что значит: ' || regexp_replace(trim(text), '\\.+$', '') || '?' AS question FROM documents")
def shown_texts(spark, sf_dir):
    """A source's label, a text cut for display, a question from a statement."""
    d = table(spark, sf_dir, "documents").withColumn("place", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("none", F.lit(" "))
    return d.select("doc_id", representations.source_label("source", "none", "place").alias("source_label"), X.cut("text", 40).alias("shown"), representations.move_question("Что значит: ", "text").alias("question"))


# ---------------------------------------------------------------- final and restored cards


def final_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    given = {"card_id": F.col("doc_id").cast("string"), "author": F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), "philosophical_move": F.concat(F.lit("Move "), "lang", F.lit("..")), "quote": F.col("text"), "translator": F.lit("")}
    return d.select(*[given.get(c, F.lit(c)).alias(c) for c in schemas.FINAL_CARD])


_FINAL = """f AS (SELECT doc_id::VARCHAR AS id, text AS fragment, 'Move ' || lang || '..' AS move, CASE WHEN doc_id % 3 <> 0 THEN nullif(source, '') END AS author FROM documents),
l AS (SELECT doc_id::VARCHAR AS id, 'old ' || lang AS t FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0)"""


@query(f"""WITH {_FINAL} SELECT f.id, author, 'Как: Move ' || substr(move, 6, length(move) - 7) || '?' AS question, sha256(move) AS a, sha256(concat_ws(chr(10), CASE WHEN f.id::BIGINT % 4 = 0 THEN 'layer ' || f.id ELSE move END, fragment)) AS b, sha256(coalesce(t, move)) AS c, t IS NOT NULL AS matched FROM f LEFT JOIN l ON f.id = l.id""")
def final_documents(spark, sf_dir):
    """Flat rows as cards, and their documents by mode: move, move and quotation under a layer, reliable legacy."""
    c = projections.final_cards(final_rows(spark, sf_dir), "Как: ")
    layer = c.where("CAST(id AS LONG) % 4 = 0").select("id", F.concat(F.lit("layer "), "id").alias("text"))
    n = F.col("id").cast("long")
    old = c.select(
        "id", F.when(n % 7 == 0, "Other move").otherwise(F.lower("move")).alias("move"), F.when(n % 5 == 0, F.concat(F.lit("###"), "move")).otherwise(F.concat(F.lit("old "), F.replace(F.replace("move", F.lit("Move "), F.lit("")), F.lit("."), F.lit("")))).alias("perspective"), (n % 2 == 0).alias("eligible"),
    )
    legacy = assembly.reliable_legacy(c.select("id", "move"), old, "id", ["###"]).withColumnRenamed("perspective", "text")
    a, b, m = (projections.mode_documents(c, *x, **y).select("id", F.sha2("text", 256).alias(k), F.col("matched").alias(f"m_{k}")) for k, x, y in (("a", ("A",), {}), ("b", ("B",), {"layer": layer}), ("c", ("C", legacy), {})))
    question = c.select("id", "author", F.get("philosophical_questions", F.lit(0)).alias("question"))
    return question.join(a, "id").join(b, "id").join(m, "id").select("id", "author", "question", "a", "b", "c", F.col("m_c").alias("matched"))


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'found' WHEN doc_id % 3 = 1 THEN 'Палийский канон' END ELSE 'work' END AS work,
CASE WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'there' WHEN doc_id % 3 = 1 THEN 'СН 35.' || doc_id END ELSE lang END AS location, CASE WHEN doc_id % 6 = 5 THEN 'registry_reserve' ELSE 'registry_curated' END AS status,
doc_id % 6 <> 5 AND (doc_id % 4 <> 1 OR doc_id % 3 <> 2) AS eligible, CASE WHEN doc_id % 5 = 0 THEN '?' ELSE 'желание' END AS coordinate, 'долг ↔ желание' AS tension FROM documents""")
def restored_registry(spark, sf_dir):
    """A registry table written and read back, its rows as cards; broken places are restored or make a row ineligible."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    cell = F.when(n % 4 == 1, F.when(n % 3 == 1, F.concat(F.lit("**СН 35."), n.cast("string"), F.lit("**"))).otherwise("nothing")).otherwise(F.col("lang"))
    number = n.cast("string")
    id_ = F.concat(F.lit("C"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))  # lpad cuts longer ones
    row = F.concat(F.lit("| "), F.concat_ws(" | ", id_, F.when(n % 6 == 5, "reserve").otherwise("main"), "lang", F.lit("author"), F.when(n % 4 == 1, "BROKEN").otherwise("work"), cell, F.lit("move."), F.lit("p"), F.when(n % 5 == 0, "Nope").otherwise("Desire"), F.lit("Duty vs desire, —"), F.lit("d")), F.lit(" |"))
    path = sinks.scratch(spark)
    d.select(row.alias("value")).write.text(path)
    r = files.registry(spark, path, id_pattern=r"C\d+").withColumn("id", F.substring("id", 2, 99).cast("long").cast("string"))
    known = d.where("doc_id % 4 = 1 AND doc_id % 3 = 0").select(n.cast("string").alias("id"), F.lit("found").alias("work"), F.lit("there").alias("location"))
    c = projections.restored_cards(r, known, "BROKEN", "Q ", {"Desire": "желание"}, {"Duty vs desire": "долг ↔ желание"})
    return c.select("id", "work", "location", "status", "eligible", F.coalesce(F.get("coordinates", F.lit(0)), F.lit("?")).alias("coordinate"), F.array_join("tensions", ";").alias("tension"))


# ---------------------------------------------------------------- queries from cases, contrasts, confirmations


def case_rows(spark, sf_dir):
    n = F.col("doc_id")
    ref = lambda t, m, own: F.struct(t.alias("text"), F.lit(m).alias("match"), own.alias("taxonomy_tension"))
    pair, none = F.concat("lang", F.lit(" ↔ "), "source"), F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("id"), F.concat(F.lit(" «"), "text", F.lit("» ")).alias("center"), F.col("lang").alias("circumstance"), F.lit("n").alias("narrative"), F.array(F.lit("e")).alias("experiences"), F.lit("node").alias("semantic_node"),
        F.transform(F.sequence(F.lit(1), (n % 5 + 1).cast("int")), lambda i: F.concat(F.lit("d"), i.cast("string"))).alias("distinctions"), F.array("lang", "source", "lang").alias("probable_coordinates"),
        F.array(ref(pair, "exact", pair), ref(F.lit("x"), "case_specific", none), ref(F.lit("y ↔ z"), "reversed_poles", pair)).alias("probable_tensions"),
    )


@query("""WITH q AS (SELECT doc_id::VARCHAR AS id, trim(text) AS question, (list_concat(['node'], list_transform(range(1, doc_id % 5 + 2), lambda i: 'd' || i)))[1:4] AS h, list_distinct([lang, source]) AS c, lang || ' ↔ ' || source AS t FROM documents),
v AS (SELECT id, unnest(['Q0_question_only', 'QH_question_hypotheses', 'QT_question_tensions', 'Q1_full', 'QTonly_tensions_only']) AS variant, unnest([question, 'Вопрос: ' || question || chr(10) || 'Рабочие интерпретации:' || chr(10) || array_to_string(list_transform(h, lambda x: '- ' || x), chr(10)),
 'Вопрос: ' || question || chr(10) || 'Смысловые напряжения:' || chr(10) || '- ' || t || chr(10) || '- x', 'Вопрос: ' || question || chr(10) || 'Рабочие интерпретации:' || chr(10) || array_to_string(list_transform(h, lambda x: '- ' || x), chr(10)), 'Смысловые напряжения:' || chr(10) || '- ' || t || chr(10) || '- x']) AS text FROM q)
SELECT id AS query_id, variant, sha256(text) AS sha256 FROM v""")
def query_ablations(spark, sf_dir):
    """Queries from cases, in five choices of their fields."""
    v = projections.query_variants(projections.case_queries(case_rows(spark, sf_dir)))
    return v.select("query_id", "variant", F.sha2("text", 256).alias("sha256"))


@query("""SELECT doc_id AS variant_id, doc_id % 3 = 0 AS known, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'Q0_QUESTION_ONLY_CONTROL,Q1_MEANING' ELSE 'Q0_QUESTION_ONLY_CONTROL,Q1_MEANING,STRUCTURE' END AS unavailable,
CASE WHEN doc_id % 3 = 2 THEN '' WHEN doc_id % 3 = 1 THEN source ELSE CASE WHEN lang = source THEN lang ELSE lang || ',' || source END END AS coordinates, CASE WHEN doc_id % 3 = 0 THEN lang || ' ↔ ' || source ELSE 'a ↔ b' END AS canonical FROM documents""")
def contrast_inputs(spark, sf_dir):
    """Contrast variants that point to a case, that have tags of their own, or that have nothing."""
    q = projections.case_queries(case_rows(spark, sf_dir))
    n = F.col("doc_id")
    own = F.array(F.struct(F.lit("a ↔ b").alias("text"), F.lit("exact").alias("match"), F.lit("a ↔ b").alias("taxonomy_tension")))
    v = table(spark, sf_dir, "documents").select(n.cast("string").alias("id"), F.when(n % 3 == 0, n.cast("string")).alias("case_ref"), F.when(n % 3 == 1, F.array("source")).otherwise(F.array().cast("array<string>")).alias("probable_coordinates"), own.alias("probable_tensions"))
    r = projections.contrast_inputs(v, q)
    return r.select(F.col("variant_id").cast("long").alias("variant_id"), F.col("confirmed_question").isNotNull().alias("known"), F.array_join("unavailable", ",").alias("unavailable"), F.array_join("coordinates", ",").alias("coordinates"), F.array_join("canonical_tensions", ",").alias("canonical"))


@query("""SELECT doc_id AS item_id, sha256(CASE doc_id % 4 WHEN 0 THEN text ELSE trim(source) END) AS question, CASE WHEN doc_id % 4 = 2 THEN 0 ELSE 1 END::BIGINT AS n_hypotheses, 'user_' || CASE doc_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'edited' ELSE 'replaced' END AS origin
FROM documents WHERE doc_id % 4 = 0 OR (doc_id % 4 IN (1, 2) AND trim(coalesce(source, '')) <> '')""")
def confirmed_questions(spark, sf_dir):
    """Queries from confirmed, edited, replaced and rejected questions."""
    some, action = F.array(F.lit("h")), F.get(F.array(*map(F.lit, ("confirmed", "edited", "replaced", "rejected"))), (F.col("doc_id") % 4).cast("int"))
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("proposed_question"), action.alias("action"), F.col("source").alias("edited_text"), F.col("lang").alias("topic"), F.lit("").alias("free_narrative"),
        *[some.alias(c) for c in ("experiences", "working_hypotheses", "coordinates", "canonical_tensions", "free_tensions")],
    )
    q = projections.confirmed_queries(d)
    return q.select("item_id", F.sha2("confirmed_question", 256).alias("question"), F.size("working_hypotheses").cast("long").alias("n_hypotheses"), F.col("confirmed_question_source").alias("origin"))


_P, _Q = "'Перспектива: ' || {0}", "'Философские вопросы:' || chr(10) || '- generic' || chr(10) || '- Вопрос: ' || source"
_C, _T = "'Координаты: ' || lang", "'Напряжения: ' || source"


@query(f"""WITH v AS (SELECT doc_id, unnest(['A_perspective', 'B_questions', 'C_persp_questions', 'D_full', 'E_full_no_tensions', 'F_full_detemplated', 'G_coords_tensions']) AS variant,
unnest([{_P.format("'T: ' || text")}, {_Q}, concat_ws(chr(10), {_P.format("'T: ' || text")}, {_Q}), concat_ws(chr(10), {_P.format("'T: ' || text")}, {_Q}, {_C}, {_T}), concat_ws(chr(10), {_P.format("'T: ' || text")}, {_Q}, {_C}),
 concat_ws(chr(10), {_P.format("trim(replace('T: ' || text, 'T:', ''))")}, 'Философские вопросы:' || chr(10) || '- ' || trim(source), {_C}, {_T}), concat_ws(chr(10), {_C}, {_T})]) AS text FROM documents) SELECT doc_id AS id, variant, sha256(text) AS sha256 FROM v""")
def document_ablations(spark, sf_dir):
    """Seven choices of a card's fields from one scan."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("T: "), "text").alias("perspective"), F.array(F.lit("generic"), F.concat(F.lit("Вопрос: "), "source")).alias("philosophical_questions"), F.array("lang").alias("coordinates"), F.array("source").alias("tensions"))
    return projections.document_variants(d, F.array(F.lit("generic")), "T:", "Вопрос:").select("id", "variant", F.sha2("text", 256).alias("sha256"))


# ---------------------------------------------------------------- repairs and checks of texts


@query(r"""SELECT doc_id, replace(replace(text, '---', '—'), '--', '–') AS typography, nullif(trim(source), '') AS source, lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.+$', '')) AS move,
CASE WHEN regexp_matches(text, '(?i)password') THEN 'secret' WHEN regexp_matches(text, '(?i)https?://') THEN 'link' ELSE 'none' END AS message,
contains(text, substr(text, 2, length(text))) AND length(text) > 1 AND len(regexp_extract_all(substr(text, 2, length(text)), '[\p{L}\p{N}_«»-]+')) BETWEEN 8 AND 45 AS verbatim FROM documents""")
def text_repairs(spark, sf_dir):
    """Typography, blanks, moves, messages by pattern, verbatim excerpts."""
    d = table(spark, sf_dir, "documents")
    rest = F.substring("text", F.lit(2), F.length("text"))
    return d.select(
        "doc_id", X.typography("text").alias("typography"), X.text_or_null("source").alias("source"), X.move_norm("text").alias("move"),
        X.message_for("text", [("(?i)password", "secret"), ("(?i)https?://", "link")], "none").alias("message"), X.verbatim_excerpt(F.col("text"), rest).alias("verbatim"),
    )


@query(r"""WITH d AS (SELECT doc_id, lower(text) AS t, lower(coalesce(source, '') || ' ' || coalesce(lang, '')) AS g, text FROM documents)
SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(t, '\d{3}') AND NOT regexp_matches(g, '\d{3}') THEN '\d{3}' END, CASE WHEN contains(t, 'en') AND NOT contains(g, 'en') THEN 'en' END, CASE WHEN contains(t, 'src') AND NOT contains(g, 'src') THEN 'src' END) AS beyond,
array_to_string(list_filter(['then', 'and', 'house'], lambda w: len(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: starts_with(x, substr(w, 1, 4)))) > 0), ',') AS stems FROM d""")
def unfounded_hits(spark, sf_dir):
    """Patterns that a text has and its ground has not, and stems that begin some word of it."""
    ground = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    d = table(spark, sf_dir, "documents").withColumn("ground", ground)
    return d.select("doc_id", F.array_join(X.hits_beyond("text", F.col("ground"), [r"\d{3}", "en", "src"]), "|").alias("beyond"), F.array_join(X.stem_hits(F.array(F.lit("then"), F.lit("and"), F.lit("house")), "text"), ",").alias("stems"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN true ELSE false END AS ambiguous FROM conversations""")
def second_questions(spark, sf_dir):
    """F16: turns with two questions, of which every third's second points back."""
    q = F.concat(F.lit("One? "), F.when(F.col("turn") % 3 == 0, "Это оно").otherwise("Этот ли путь"), F.lit("? "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.ambiguous_second_question(q, "это|он").alias("ambiguous"))


@query("""SELECT 'duplicate' AS problem, 0::BIGINT AS card_id FROM range(1) WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id = 0) UNION ALL SELECT 'blank', doc_id FROM documents WHERE doc_id % 50 = 7 UNION ALL SELECT 'unknown', -doc_id - 1 FROM documents WHERE doc_id % 50 = 9 UNION ALL SELECT 'versions', NULL FROM range(1) WHERE (SELECT count(*) FROM documents) > 1""")
def overlay_contract(spark, sf_dir):
    """What breaks the contract of an overlay of all documents."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    layer = d.select(F.when(n % 50 == 9, -n - 1).otherwise(n).alias("card_id"), F.when(n % 50 == 7, " ").otherwise(F.concat(F.lit("t "), "text")).alias("retrieval_text"), F.when(n % 2 == 0, "v1").otherwise("v2").alias("layer_version"))
    layer = layer.union(layer.where("card_id = 0"))
    return files.overlay_problems(layer, layer.columns, d.select(n.alias("card_id"))).select("problem", F.col("card_id").cast("long").alias("card_id"))


# ---------------------------------------------------------------- interpretations, runs

_KINDS = [
    ("NOT_A_QUESTION", "proposed_question"), ("HYPOTHESES_COUNT", "working_hypotheses"), ("OTHER_QUESTIONS_COUNT", "other_questions"), ("DIAGNOSTIC_LABEL", "proposed_question"), ("ADVICE", "proposed_question"), ("NO_COORDINATES", "coordinates"),
    ("COORDINATE_NOT_CANONICAL", "coordinates"), ("DUPLICATE_VALUE", "canonical_tensions"), ("TENSION_NOT_CANONICAL", "canonical_tensions"), ("CANONICAL_AS_FREE", "free_tensions"), ("TENSION_FORMAT", "free_tensions"),
]


@query("WITH k(k, code, field) AS (VALUES " + ", ".join(f"({k}, '{c}', '{f}')" for k, (c, f) in enumerate(_KINDS)) + f") SELECT doc_id AS card_id, 'error' AS severity, code, field FROM documents JOIN k ON doc_id % {len(_KINDS) + 2} = k UNION ALL SELECT doc_id, 'error', 'DUPLICATE_VALUE', 'coordinates' FROM documents WHERE doc_id % {len(_KINDS) + 2} = 7")
def interpretation_issues(spark, sf_dir):
    """An interpretation of each document with one fault; a clinical word is none where the person used it."""
    n = F.col("doc_id") % (len(_KINDS) + 2)
    items = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    pick = lambda base, **faults: F.coalesce(*[F.when(n == int(k[1:]), v) for k, v in faults.items()], base)
    a, b = schemas.COORDINATES[:2]
    t, u = schemas.TENSIONS[:2]
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), pick(F.lit("Что здесь? "), f0=F.lit("Ответ."), f3=F.lit("Это Депрессия?"), f4=F.lit("Вам нужно решить?"), f11=F.lit("Это депрессия?")).alias("proposed_question"),
        pick(items("h", "g"), f1=items("h")).alias("working_hypotheses"), pick(items(), f2=items(*"abcd")).alias("other_questions"), F.when(n == 11, F.concat("text", F.lit(" Депрессия"))).otherwise(F.col("text")).alias("free_narrative"), F.col("lang").alias("difficulty_center"),
        pick(items(a, b), f5=items(), f6=items(a, "x"), f7=items(a, a)).alias("coordinates"), pick(items(t), f7=items(t, t), f8=items(t, "y")).alias("canonical_tensions"), pick(items("a ↔ b"), f9=items(u), f10=items("a b")).alias("free_tensions"),
    )
    return rules.row_issues(d, interpretations.interpretation_rules()).select("card_id", "severity", "code", "field")


@query("WITH q AS (SELECT doc_id FROM documents) SELECT doc_id AS card_id, 'error' AS severity, unnest(list_filter([CASE WHEN doc_id % 4 = 1 THEN 'QUESTION_BLANK' END, CASE WHEN doc_id % 6 = 2 THEN 'HYPOTHESES_COUNT' END, 'FORBIDDEN_ATTRIBUTE'], lambda x: x IS NOT NULL)) AS code FROM q")
def query_issues(spark, sf_dir):
    """Queries with blank questions, too many hypotheses, and an attribute that none may have."""
    n, none = F.col("doc_id"), F.array().cast("array<string>")
    d = table(spark, sf_dir, "documents").select(
        n.alias("id"), F.when(n % 4 == 1, " ").otherwise(F.col("text")).alias("confirmed_question"), F.array_repeat(F.lit("h"), F.when(n % 6 == 2, 5).otherwise(4)).alias("working_hypotheses"),
        F.array(F.lit(schemas.COORDINATES[0])).alias("coordinates"), none.alias("canonical_tensions"), none.alias("free_tensions"), F.col("lang").alias("country"),
    )
    return rules.row_issues(d, interpretations.query_rules(d.columns)).select("card_id", "severity", "code")


_TRACES = """z AS (""" + CATALOGUE["retrieve_all"][1] + """), t AS (SELECT query_id, count(meaning_rank) AS n_meaning, count(structure_rank) AS n_structure, count(*) FILTER (in_union) AS n_pool, count(*) FILTER (meaning_rank IS NOT NULL AND structure_rank IS NOT NULL) AS n_both, arg_min(card_id, meaning_rank) AS best FROM z GROUP BY 1)"""


@query(f"WITH {_TRACES} SELECT query_id AS item_id, n_meaning, n_structure, n_pool, n_both, best FROM t")
def run_traces(spark, sf_dir):
    """Nested traces of a run, read back: how many candidates each route and the pool have."""
    t = interpretations.traces(CATALOGUE["retrieve_all"][0](spark, sf_dir), vector_queries(spark, sf_dir).select("query_id"), "r1", "0.1")
    n = lambda c: F.size(c).cast("long")
    return t.select("item_id", n("meaning_candidates").alias("n_meaning"), n("structure_candidates").alias("n_structure"), n("candidate_pool").alias("n_pool"), F.size(F.filter("candidate_pool", lambda c: F.size(c["found_by"]) == 2)).cast("long").alias("n_both"), F.get("meaning_candidates", F.lit(0))["fragment_id"].alias("best"))


@query("SELECT 'r1' AS retrieval_run_id, 'plain' AS composer, 'none' AS model, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS cases, (SELECT count(*) FROM embeddings WHERE vec_id % 60 = 0) AS composed, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 60 <> 0) AS pending")
def run_summary(spark, sf_dir):
    """The manifest of a run whose every third case is composed."""
    q = vector_queries(spark, sf_dir).select("query_id")
    t = interpretations.traces(CATALOGUE["retrieve_all"][0](spark, sf_dir), q, "r1", "0.1")
    return interpretations.run_manifest(t, q.where("query_id % 60 = 0").select(F.col("query_id").alias("item_id")), "plain", "none")


@query("""SELECT doc_id AS query_id, doc_id AS card_id, sha256(concat_ws(chr(10), CASE WHEN trim(coalesce(source, '')) <> '' THEN 'Источник: ' || source END, CASE WHEN doc_id % 3 <> 0 AND trim(text) <> '' THEN 'Цитата: ' || text END, 'Перспектива: ' || lang)) AS brief,
sha256(concat_ws(chr(10) || chr(10), CASE WHEN trim(text) <> '' THEN trim(text) END, CASE WHEN trim(coalesce(lang, '')) <> '' THEN trim(lang) END, 'Why?', CASE WHEN trim(coalesce(source, '')) <> '' THEN trim(source) END)) AS copied FROM documents""")
def card_texts(spark, sf_dir):
    """Briefs and plain texts of cards."""
    d = table(spark, sf_dir, "documents")
    c = d.select(F.col("doc_id").alias("card_id"), F.col("source").alias("label"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("quote"), F.col("lang").alias("perspective"))
    brief = interpretations.writer_brief(d.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("card_id")), c)
    copied = interpretations.copy_text(d.select("doc_id", F.col("text").alias("main_idea"), F.col("lang").alias("applied_insight"), F.lit("Why?").alias("reflection_question"), F.col("source").alias("reference")), "doc_id")
    return brief.join(copied, F.col("card_id") == F.col("doc_id")).select("query_id", "card_id", F.sha2("brief", 256).alias("brief"), F.sha2("text", 256).alias("copied"))


# ---------------------------------------------------------------- sources to cards, end to end

_SOURCED = "d AS (SELECT *, 'C' || lpad(doc_id::VARCHAR, 4, '0') AS id FROM documents WHERE doc_id BETWEEN 0 AND 9999)"


def _written(spark, sf_dir):
    """The paths of the source files, made of documents: launch table, recovery sections, unresolved list, curation, as their readers want them."""
    d = table(spark, sf_dir, "documents").where("doc_id BETWEEN 0 AND 9999")  # a card's id has four digits
    n, id_ = F.col("doc_id"), F.concat(F.lit("C"), F.lpad(F.col("doc_id").cast("string"), 4, "0"))
    paths = {k: sinks.scratch(spark) for k in ("launch", "recovery", "status", "curation")}
    row = F.concat(F.lit("| "), F.concat_ws(" | ", id_, "lang", "source", F.concat(F.lit("p"), n.cast("string")), F.lit("move.")), F.lit(" |"))
    d.where(n % 4 != 3).select(row.alias("value")).write.text(paths["launch"])
    part = F.concat(F.lit("### "), id_, F.lit("\n\n- **work:** found "), n.cast("string"), F.lit("\n- **location:** there\n"))
    d.where(n % 5 == 0).select(part.alias("value")).write.text(paths["recovery"])
    listed = d.where(n % 7 == 0).groupBy(F.pmod(n, F.lit(13)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), id_))), "\n").alias("ids"))
    listed.select("part", F.concat(F.lit("C0001\nUnresolved:\n"), "ids", F.lit("\n\n## next\nC0002")).alias("value")).repartition("part").write.partitionBy("part").text(paths["status"])
    update = F.concat(F.lit('{"fragments": {"'), id_, F.lit('": {"set": {"tradition": "cured"}}}}'))
    d.where(n % 11 == 0).groupBy(F.pmod(n, F.lit(5)).alias("part")).agg(F.concat(F.lit('{"fragments": {'), F.array_join(F.collect_list(F.substring(update, F.lit(16), F.length(update) - 17)), ", "), F.lit("}}")).alias("value")).repartition("part").write.partitionBy("part").text(paths["curation"])
    return paths


@query(f"""WITH {_SOURCED} SELECT id, CASE WHEN doc_id % 11 = 0 THEN 'cured' ELSE lang END AS tradition, CASE WHEN doc_id % 5 = 0 THEN 'found ' || doc_id ELSE source END AS work, CASE WHEN doc_id % 5 = 0 THEN 'there' ELSE 'p' || doc_id END AS location,
CASE WHEN doc_id % 7 = 0 THEN 'unresolved' ELSE 'verified' END AS status FROM d WHERE doc_id % 4 <> 3""")
def assembled_sources(spark, sf_dir):
    """Four kinds of source files read and put together by their precedence: recovery over launch, curation over both."""
    paths = _written(spark, sf_dir)
    launch = files.launch_table(spark, paths["launch"])
    r = files.recovery(spark, paths["recovery"]).select("id", F.element_at("fields", "work").alias("work"), F.element_at("fields", "location").alias("location"))
    cards = assembly.assemble(launch, [(r, ["work", "location"], "recovery")], "id")
    unresolved = files.unresolved_ids(spark, paths["status"]).distinct().withColumn("listed", F.lit(True))
    cards = cards.join(unresolved, "id", "left").withColumn("status", F.when(F.col("listed"), "unresolved").otherwise("verified"))
    updates = files.curation(spark, f"{paths['curation']}/*", glob="*.txt")
    return assembly.curate(cards, updates, "id", ["tradition", "work", "location"]).select("id", "tradition", "work", "location", "status")


@query(f"WITH {_SOURCED} SELECT 'recovery' AS source, id FROM d WHERE doc_id % 5 = 0 AND doc_id % 4 = 3 UNION ALL SELECT 'status', id FROM d WHERE doc_id % 7 = 0 AND doc_id % 4 = 3")
def source_orphans(spark, sf_dir):
    """Ids that recovery notes and the status list have and the launch table hasn't."""
    paths = _written(spark, sf_dir)
    others = {"recovery": files.recovery(spark, paths["recovery"]).select("id"), "status": files.unresolved_ids(spark, paths["status"])}
    return assembly.orphans(others, files.launch_table(spark, paths["launch"]), "id")


# ---------------------------------------------------------------- contracts of files, packages, reports


def _flat(spark, sf_dir):
    n = F.col("doc_id")
    id_ = F.when(n % 17 == 3, F.lit(" ")).when(n % 17 == 5, F.lit("X1")).when(n % 17 == 7, F.lit("C0001")).otherwise(F.concat(F.lit("C"), F.lpad(n.cast("string"), 4, "0")))
    given = {"card_id": id_, "philosophical_move": F.when(n % 19 == 2, " ").otherwise("m"), "quote": F.when(n % 23 == 4, "").otherwise(F.col("text")), "verification_status": F.when(n % 29 == 6, "rejected").otherwise("ok")}
    return table(spark, sf_dir, "documents").where("doc_id BETWEEN 0 AND 9999").select((n + 2).alias("line"), *[given.get(c, F.lit(c)).alias(c) for c in schemas.FINAL_CARD])


_FLAT = """f AS (SELECT doc_id + 2 AS line, CASE WHEN doc_id % 17 = 3 THEN ' ' WHEN doc_id % 17 = 5 THEN 'X1' WHEN doc_id % 17 = 7 THEN 'C0001' ELSE 'C' || lpad(doc_id::VARCHAR, 4, '0') END AS card_id, doc_id % 17 <> 3 AS there, doc_id AS n, text FROM documents WHERE doc_id BETWEEN 0 AND 9999),
d AS (SELECT card_id, min(line) AS first FROM f WHERE there GROUP BY 1 HAVING count(*) > 1),
i AS (SELECT line, card_id, 'blank card_id' AS problem FROM f WHERE NOT there UNION ALL SELECT line, card_id, 'malformed card_id' FROM f WHERE card_id = 'X1' UNION ALL SELECT line, card_id, 'blank philosophical_move' FROM f WHERE there AND n % 19 = 2
 UNION ALL SELECT line, card_id, 'blank quote' FROM f WHERE there AND (n % 23 = 4 OR trim(coalesce(text, '')) = '') UNION ALL SELECT line, card_id, 'forbidden verification_status' FROM f WHERE there AND n % 29 = 6
 UNION ALL SELECT line, f.card_id, 'duplicate card_id' FROM f JOIN d ON f.card_id = d.card_id WHERE line > first UNION ALL SELECT line, card_id, 'excluded' FROM f WHERE card_id IN (SELECT 'C' || lpad(item_id::VARCHAR, 4, '0') FROM benchmark))"""


@query(f"WITH {_FLAT} SELECT line, card_id, problem FROM i")
def final_corpus_problems(spark, sf_dir):
    """The contract of the flat file over a row for each document; the benchmark's ids are the exclusion list."""
    excluded = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("C"), F.lpad(F.col("item_id").cast("string"), 4, "0")).alias("card_id"))
    return rules.final_corpus_issues(_flat(spark, sf_dir), schemas.FINAL_CARD, excluded, ["rejected"])


@query("WITH t AS (SELECT DISTINCT source AS title FROM documents), s AS (SELECT DISTINCT source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ', more' END AS section, CASE WHEN source < 'src2' THEN 'here' ELSE lang END AS location FROM documents), x AS (SELECT title, location FROM t JOIN s ON title = section), b AS (SELECT title, location FROM t JOIN s ON starts_with(section, title) WHERE title NOT IN (SELECT title FROM x)), u AS (SELECT * FROM x UNION ALL SELECT * FROM b) SELECT title, min(location) AS location FROM u GROUP BY title HAVING count(DISTINCT location) = 1")
def single_places(spark, sf_dir):
    """the place of each source, where the sections that have its title, or else begin with it, agree on one."""
    d = table(spark, sf_dir, "documents")
    section = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "").otherwise(", more"))
    return assembly.single_match(d.select(F.col("source").alias("title")).distinct(), d.select(section.alias("section"), F.when(F.col("source") < "src2", "here").otherwise(F.col("lang")).alias("location")).distinct())


_UNION = CATALOGUE["candidate_union"][1]


@query(f"WITH z AS ({_UNION}) SELECT query_id, count(*) AS n_candidates, count(*) FILTER (card_id % 7 = 0) AS n_lost, array_to_string(list(card_id ORDER BY card_id), ',') AS cards FROM z GROUP BY query_id")
def composer_packages(spark, sf_dir):
    """Each query's candidates as one package; every seventh card is missing and counted."""
    u = CATALOGUE["candidate_union"][0](spark, sf_dir)
    texts = u.select("card_id").distinct().where("card_id % 7 <> 0").select("card_id", F.concat(F.lit("card "), F.col("card_id").cast("string")).alias("text"))
    p = representations.package(u.select("query_id", "card_id", "found_by"), texts)
    return p.select("query_id", "n_candidates", "n_lost", F.array_join(F.transform("candidates", lambda c: c["card_id"].cast("string")), ",").alias("cards"))


@query("""WITH c AS (SELECT doc_id % 20 AS query_id, doc_id AS card_id, CASE doc_id % 3 WHEN 0 THEN 'selected' ELSE 'weak' END AS decision, lang AS reason FROM documents), k AS (SELECT query_id, card_id FROM c WHERE card_id % 15 = 0),
r AS (SELECT query_id, card_id, decision || ': ' || trim(reason) AS reason, 0 AS o FROM c WHERE decision <> 'selected' UNION ALL SELECT query_id, card_id, 'old ' || reason, 1 FROM c WHERE card_id % 2 = 0),
f AS (SELECT r.*, row_number() OVER (PARTITION BY query_id, card_id ORDER BY o, reason) AS n FROM r WHERE card_id % 15 <> 0) SELECT query_id, card_id, reason FROM f WHERE n = 1""")
def rejected_cards(spark, sf_dir):
    """M9: why cards weren't taken: the present decision first, then older lists."""
    c = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("card_id"), F.when(F.col("doc_id") % 3 == 0, "selected").otherwise("weak").alias("decision"), F.col("lang").alias("reason"))
    old = c.where("card_id % 2 = 0").select("query_id", "card_id", F.concat(F.lit("old "), "reason").alias("reason"))
    return compositions.rejected(c, old, c.where("card_id % 15 = 0").select("query_id", "card_id"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, round(CASE WHEN sum(length(line)) > 0 THEN coalesce(sum(length(line)) FILTER (line = 'Lorem ipsum' OR starts_with(line, 'The') OR starts_with(line, 'El')), 0) / sum(length(line)) ELSE 0 END, 9) AS share FROM l GROUP BY doc_id""")
def template_shares(spark, sf_dir):
    """The share of each text's characters in lines that begin like a template."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(diagnostics.text_shares("text", F.array(F.lit("Lorem ipsum")), ("The", "El")), 9).alias("share"))


@query("SELECT doc_id, lang || ',' || source || ',x' AS first_three, CASE WHEN contains(lang, 'e') THEN 'with' ELSE 'other' END AS chosen FROM documents")
def limited_lists(spark, sf_dir):
    """The first distinct items of a list; a choice by key with a default."""
    table_ = F.create_map(F.lit("en"), F.lit("with"), F.lit("de"), F.lit("with"), F.lit("es"), F.lit("with"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(retrieval.limited(F.array("lang", "source", "lang", F.lit("x")), 3), ",").alias("first_three"), X.option(table_, F.col("lang"), F.lit("other")).alias("chosen"))


@query("""WITH r AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT '| lang | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || coalesce(lang, '') || ' | ' || n || ' |', chr(10) ORDER BY lang) AS text FROM r""")
def report_table(spark, sf_dir):
    """K9: a report's rows as a table of Markdown."""
    return sinks.markdown_table(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), ["lang"], "lang", "n")


@query("SELECT doc_id AS item_id, lang, (SELECT count(*) FROM documents) AS n FROM documents")
def written_run(spark, sf_dir):
    """K3–K5: a run's traces and a section of its report, written to a new folder and read back."""
    path = sinks.scratch(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    sinks.write_run(d, path, "r1", counts=d.agg(F.count("*").alias("n")))
    counts = spark.read.schema("n long").json(f"{path}/run_id=r1/counts")  # a single row
    return spark.read.schema("item_id long, lang string, run_id string").json(f"{path}/run_id=r1/traces").where("run_id = 'r1'").select("item_id", "lang").crossJoin(counts)


@query("SELECT 'COUNT_MISMATCH' AS code, (SELECT count(*) FROM benchmark) AS expected, (SELECT count(*) FROM documents) AS actual FROM range(1) WHERE (SELECT count(*) FROM benchmark) <> (SELECT count(*) FROM documents)")
def count_mismatch(spark, sf_dir):
    """A declared number of rows, here the benchmark's, against the rows there are."""
    return rules.count_issue(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").count())


@query("SELECT item_id, replace(replace(text, 'zzz', ''), 'qqq', '') = text AS plain, 'Read «Beta» and «Alpha One», not Alphabet, «Beta».' AS titled FROM benchmark")
def quoted_titles(spark, sf_dir):
    """Titles put in guillemets, unless they stand in some or inside a word."""
    d = table(spark, sf_dir, "benchmark")
    text = F.lit("Read Beta and Alpha One, not Alphabet, «Beta».")
    return d.select("item_id", X.quote_titles("text", ["zzz", "qqq"]).eqNullSafe(F.col("text")).alias("plain"), X.quote_titles(text, ["Alpha One", "Beta"]).alias("titled"))
