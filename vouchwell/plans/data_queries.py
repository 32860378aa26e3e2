"""Queries of which SQL finds the outcome from the tables: files, addresses, names, nested records,
and claims about careers made from orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BinaryType

from vouchwell.functions import guard, identity, timeline
from vouchwell.functions.entities import unescape
from vouchwell.functions.gate import gate
from vouchwell.operators import brief, dialects, named, prompts, records
from vouchwell.plans import pipeline
from vouchwell.plans import sql_values as V
from vouchwell.plans.made_pdfs import STYLES, make_pdf
from vouchwell.plans.oracle import half_even
from vouchwell.plans.queries import keyed, read, spread, texts
from vouchwell.sources import accounts, files


@pandas_udf(BinaryType())
def _pdf_of(text: pd.Series, style: pd.Series) -> pd.Series:
    return pd.Series([make_pdf(t, s) for t, s in zip(text, style)])


def pdf_texts(spark, sf_dir):
    """PDFs made from documents in six ways, read back; scans and damaged files refused."""
    d = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    style = F.get(F.array(*map(F.lit, STYLES)), F.pmod("doc_id", F.lit(len(STYLES))).cast("int"))
    latin = F.col("text").rlike(r"\A[\t-~ -ÿ]*+\z")
    content = _pdf_of("text", F.when((style == "literal") & ~latin, F.lit("hex")).otherwise(style))
    found, refused = files.read_sources(d.select(F.col("doc_id").alias("path"), content.alias("content")))
    none = F.lit(None).cast("string")
    kept = found.select(F.col("path").alias("doc_id"), F.md5("text").alias("digest"), none.alias("reason"))
    return kept.unionByName(refused.select(F.col("path").alias("doc_id"), none.alias("digest"), "reason"))


def _escaped(text: Column) -> Column:
    """Marks and accented letters as references: by name, by number, and where the standard lets
    them, without a semicolon."""
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("é", "&eacute;"), ("è", "&#232;"), ("ü", "&#xFC;"), ("ñ", "&ntilde;"), ("…", "&hellip;")):
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return F.regexp_replace(F.regexp_replace(text, "ç(?=[ .,\\n])", "&ccedil"), "ß", "&#x000DF")


def entity_texts(spark, sf_dir):
    """Documents with references in place of marks and letters, decoded again."""
    d = texts(spark, sf_dir).filter("text not rlike 'ß[0-9a-fA-F;]'")
    return d.select("doc_id", F.md5(unescape(_escaped(F.col("text")))).alias("digest"))


def naming_turns(spark, sf_dir):
    """User turns that share a word, in any form, with a span's label; labels are the first words
    of benchmark passages."""
    claims = read(spark, sf_dir, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.substring("text", 1, 60).alias("said")
    )
    spans = read(spark, sf_dir, "benchmark").select(F.substring("text", 1, 40).alias("label"))
    return named.naming(claims, "claim_id", "said", spans, "label").select("claim_id", "stem", "spans")


def nested_records(spark, sf_dir):
    """The fields of events' JSON, twenty levels down for every third event."""
    e = read(spark, sf_dir, "events", "event_id", "event_type", "props").filter("event_id % 7 = 0")
    deep = F.concat(F.repeat(F.lit('{"in":'), F.lit(20)), F.col("props"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'), F.repeat(F.lit("}"), F.lit(19)))
    body = F.when(F.col("event_id") % 3 == 0, deep).otherwise(F.col("props"))
    return records.flatten_json(spread(e).select("event_id", body.alias("body")), "event_id", "body")


def page_requests(spark, sf_dir):
    """Pages asked for by other spellings of their addresses; those nobody fetched, refused."""
    p = read(spark, sf_dir, "pages", "page_id", "url", "html")
    k, bare = F.col("page_id") % 5, F.regexp_replace("url", r"^https?://(?:www\.)?", "")
    asked = (
        F.when(k == 0, F.concat(F.lit("HTTPS://www."), F.upper(F.regexp_extract(bare, "^[^/]*", 0)), F.regexp_extract(bare, "/.*$", 0)))
        .when(k == 1, bare)
        .when(k == 2, F.concat("url", F.lit("#top")))
        .when(k == 3, F.regexp_replace("url", "^(https?://[^/]*)", "$1:80"))
        .otherwise(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/none")))
    )
    entry = p.select(F.col("page_id").alias("asker"), F.concat(F.lit("ada-x, "), asked).alias("entry"))
    requests = files.parse_requests(entry, "asker", "entry")
    found, refused = files.meet_pages(requests, spread(p), "page_id", "url", "html")
    none = F.lit(None)
    kept = found.select("asker", "page_id", F.length("text").cast("long").alias("n"), none.cast("string").alias("reason"))
    return kept.unionByName(refused.select("asker", none.cast("long").alias("page_id"), none.cast("long").alias("n"), "reason"))


def account_failures(spark, sf_dir):
    """A landing table of accounts' pages, with those that couldn't be had and why."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    status = lambda n: F.when(F.col("c_custkey") % n == 0, 404).when(F.col("c_custkey") % n == 1, 403).when(F.col("c_custkey") % n == 2, 502).otherwise(200)
    own = c.select(F.col("c_name").alias("login"), F.lit("account").alias("kind"), status(11).alias("status"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("body"))
    repos = F.to_json(F.array(F.struct(F.lit("a").alias("name"), F.lit(False).alias("fork"), F.lit("2020-01-01").alias("pushed_at")), F.struct(F.lit("b").alias("name"), (F.col("c_custkey") % 2 == 0).alias("fork"), F.lit("2021-01-01").alias("pushed_at"))))
    lists = c.select(F.col("c_name").alias("login"), F.lit("repos").alias("kind"), status(13).alias("status"), repos.alias("body"))
    people, kept, failures = accounts.accounts_of(own.unionByName(lists))
    counted = people.join(kept.groupBy("login").agg(F.count("*").alias("repos")), "login", "left")
    none = F.lit(None)
    a = counted.select("login", "name", "repos", none.cast("string").alias("reason"))
    return a.unionByName(failures.select("login", none.cast("string").alias("name"), none.cast("long").alias("repos"), "reason"))


#: What the gate is asked about: an opening, and an entry of each of its lists.
GATED = (
    ("Wants to", "hoping to"), ("Aspires, and", "seek "), ("Moved away, and", "left"), ("Gave up, and", "stepped back"),
    ("Mentors, and", "head of"), ("Director:", "supervises"), ("Tired of it:", "because"), ("Scarred:", "in the wake of"), ("Quit 12 of 1,300:", "exited 1300"),
)


def gate_passages(spark, sf_dir):
    """The gate with its own lists over passages of documents, a claim's opening before one and
    an entry, or none, before the next."""
    d = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pick = lambda i: F.get(F.array(*[F.lit(g[i]) for g in GATED]), F.pmod("doc_id", F.lit(len(GATED))).cast("int"))
    claim = F.concat(pick(0), F.lit(" "), F.substring("text", 1, 50))
    quote = F.concat(F.when(F.col("doc_id") % 2 == 0, pick(1)).otherwise(F.lit("")), F.lit(" "), F.substring("text", 51, 90))
    return d.select("doc_id", gate(claim, quote)["rule"].alias("rule"))


OVENS = "Rose at four every single day to light the ovens"
CLASS = "Every class is one that she is hoping to teach again"


def _careers(spark, sf_dir):
    """A profile per customer: up to three roles with the years of its orders by status, and a
    sentence under each; and the response recorded for it."""
    year = F.year("o_orderdate")
    of = lambda status, c: F.max(F.when(F.col("o_orderstatus") == status, c))
    spans = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min(year).alias("a"), F.max(year).alias("z"), F.count("*").alias("n"))
    wide = spans.groupBy("o_custkey").agg(
        *[of(s, F.struct("a", "z", "n")).alias(name) for s, name in (("F", "baker"), ("O", "teacher"), ("P", "sailor"))]
    )
    part = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    baker = part("Baker at Corner Bakery\n", F.col("baker.a"), " - ", F.col("baker.z"), f"\n{OVENS}.")
    teacher = part("Teacher at North School\n", F.col("teacher.a"), f" - Present\n{CLASS}.")
    sailor = part("Sailor on river boats\n", F.col("sailor.a"), " - ", F.col("sailor.z"), "\nLed a crew of ", F.col("sailor.n"), " on the long river run.")
    claim = lambda said, quote: F.struct(said.alias("description"), F.lit(quote).alias("evidence"), F.lit(0.8).alias("confidence"))
    body = F.to_json(
        F.struct(
            F.lit("Kept moving on").alias("throughline"),
            F.array(*[F.lit(q) for q in (CLASS, "Somebody wrote this elsewhere", OVENS, f"“{CLASS}”")]).alias("throughline_evidence"),
            F.array(
                claim(F.lit("Moved from baking to teaching"), OVENS),
                claim(F.lit("Left the water"), "on the long river run"),
            ).alias("departures"),
            F.array(
                claim(F.lit("Wants to teach"), CLASS),
                F.struct(
                    part("Led ", F.col("sailor.z") - F.col("sailor.a") + 1).alias("description"),
                    part("Led a crew of ", F.col("sailor.n"), " on the long river run").alias("evidence"),
                    F.lit(0.95).alias("confidence"),
                ),
            ).alias("pursuits"),
        )
    )
    made = wide.select(F.col("o_custkey").alias("profile_id"), F.concat_ws("\n", F.lit("Somebody"), teacher, baker, sailor).alias("raw_text"), body.alias("content"))
    made = keyed(made, "profile_id")
    return made.select("profile_id", "raw_text"), made.select("profile_id", "content")


def career_claims(spark, sf_dir):
    """Claims about careers, each kept, or dropped by its quote, by the record's dates
    or by the gate."""
    run = pipeline.verify(*_careers(spark, sf_dir))
    kept = run.kept.select("profile_id", "kind", "pos", F.lit("kept").alias("outcome"), "confidence")
    why = F.when(F.col("reason").isin("contradicts_dates", "unsupported"), F.col("reason")).otherwise(F.lit("unverified"))
    return kept.unionByName(run.drops.select("profile_id", "kind", "pos", why.alias("outcome"), F.lit(None).cast("double").alias("confidence")))


def career_arcs(spark, sf_dir):
    """What the arcs of the careers come to."""
    a = pipeline.verify(*_careers(spark, sf_dir)).arcs
    return a.select(
        "profile_id", F.col("proposed").cast("long").alias("proposed"), F.col("kept").cast("long").alias("kept"), "drop_rate", "confidence",
        F.array_join("throughline_evidence", "|").alias("headline"),
    )


ROLES = ((1, "Baker", "Bakers who light ovens every day, and teach."), (2, "Skipper", "A river crew wants someone for the long run"), (3, "Nothing", "Anything at all"))


def _assessed(spark, sf_dir):
    """The careers' run, each with the role of its number and the verdict recorded for the two."""
    profiles, said = _careers(spark, sf_dir)
    named = profiles.select("*", F.concat(F.lit("Customer "), F.col("profile_id")).alias("name"))
    roles = spark.createDataFrame(ROLES, "role_id long, title string, raw_description string").withColumn("company_context", F.lit(""))
    k = F.col("profile_id")
    verdict = F.get(F.array(*map(F.lit, ("true", "false", '"Ambiguous"', "null", '"yes"'))), (k % 5).cast("int"))
    body = F.concat(
        F.lit('{"continues_arc": '), verdict, F.lit(', "reasoning": "'), F.when(k % 11 == 0, F.lit(" ")).when(k % 7 == 0, F.lit("Hi Ada, come along")).otherwise(F.lit("So it seems")),
        F.lit('", "risk_flags": [" far ", "", "let me know if you agree"]}'),
    )
    fits = profiles.select("profile_id", (k % 3 + 1).alias("role_id"), body.alias("content"))
    return pipeline.run(named, said, roles, fits)


def career_fits(spark, sf_dir):
    """Verdicts on a role, held back where the arc is thin; responses without
    reasoning, refused."""
    fits = _assessed(spark, sf_dir).judged
    good = lambda c: F.when(F.col("failure").isNull(), c)
    return fits.select(
        "profile_id", "role_id", good(F.col("continues_arc")).alias("continues_arc"), good(F.col("withheld")).alias("withheld"),
        good(F.size("risk_flags").cast("long")).alias("flags"), good(F.array_join("skill_overlap.matched", " ")).alias("shared"),
        good(F.col("skill_overlap.ratio")).alias("ratio"), "failure",
    )


def career_briefs(spark, sf_dir):
    """The careers' briefs as a human reads them."""
    return brief.render(brief.reject_violations(_assessed(spark, sf_dir).briefs))


def career_prompts(spark, sf_dir):
    """What a model would be shown of the careers, with their dated roles in order."""
    profiles, _ = _careers(spark, sf_dir)
    more = profiles.select("*", F.lit("Ada").alias("name"), F.array(F.lit("Baker"), F.lit("Sailor")).alias("known_roles"), F.lit("orders").alias("source_notes"))
    return prompts.story_prompts(more)


def date_forms(spark, sf_dir):
    """An order's years in each form of a date line, under a label or beside it."""
    o = spread(read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate"))
    a, k = F.year("o_orderdate"), F.col("o_orderkey") % 7
    z, m = a + (F.col("o_orderkey") % 4).cast("int"), F.month("o_orderdate")
    two = lambda y: F.concat(F.lit("'"), F.lpad((y % 100).cast("string"), 2, "0"))
    line = (
        F.when(k == 0, F.concat(F.lit("\nJanuary "), a, F.lit(" - Mar "), z))
        .when(k == 1, F.concat(F.lit("\n"), m, F.lit("/"), a, F.lit(" to 12."), z))
        .when(k == 2, F.concat(F.lit("\n1/2/"), a, F.lit(" until 3/4/"), z))
        .when(k == 3, F.concat(F.lit("\n· "), two(a), F.lit(" – "), two(z)))
        .when(k == 4, F.concat(F.lit("\nSince May "), a))
        .when(k == 5, F.concat(F.lit(", Old Mill, "), a, F.lit(" - "), z))
        .otherwise(F.concat(F.lit("\n\n("), a, F.lit(" — Present)")))
    )
    text = F.concat(F.lit("Some words before it.\n\nDesk "), F.col("o_orderstatus"), line, F.lit("\nand after"))
    s = o.select("o_orderkey", F.explode(timeline.spans(text)).alias("s"))
    return s.select("o_orderkey", "s.label", "s.start", F.col("s.end").alias("stop"), "s.line")


def document_people(spark, sf_dir):
    """Documents with planted handles, addresses and headings: of one person or of two?"""
    d = texts(spark, sf_dir)
    k, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    planted = (
        F.when(k == 0, F.concat(F.lit("\nlinkedin.com/in/ada-"), i, F.lit(" and LinkedIn.com/in/Bo_"), i))
        .when(k == 1, F.concat(F.lit("\nMail a"), i, F.lit("@b.org or C"), i, F.lit("@d.org")))
        .when(k == 2, F.lit("\nExperience\nx\n Education:\ny\nexperience\nz\nEDUCATION"))
        .otherwise(F.lit(""))
    )
    p = identity.one_person(F.concat(F.coalesce("text", F.lit("")), planted))
    return d.select("doc_id", p.alias("p")).select("doc_id", "p.ok", "p.reason", F.array_join("p.evidence", "|").alias("evidence"))


def guarded_turns(spark, sf_dir):
    """Turns that cite a message, read with the citation exempt and without, and in quarantine."""
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    cited = F.concat(F.lit("Hi Ada, would you be open to it? No. "), F.col("turn").cast("string"))
    said = F.concat(F.col("text"), F.lit(' He wrote: "'), cited, F.when(F.col("turn") % 3 == 1, F.lit('" Let me know if you agree')).otherwise(F.lit('"')))
    kind, bare, held = guard.sendable_kind(said), guard.sendable_kind(said, F.array(cited)), guard.quarantine(F.replace(said, cited, F.lit("")), "held")
    return c.select("conv_id", "turn", kind.alias("kind"), bare.alias("kind_without"), F.md5(held["value"]).alias("kept"))


def _doubted(spark, sf_dir):
    """Documents as profiles, with claims on which the two sets of rules part."""
    d = texts(spark, sf_dir).filter(F.length("text") >= 120).select(F.col("doc_id").alias("profile_id"), F.col("text").alias("raw_text"))
    claim = lambda said, at, n, sure: F.struct(F.lit(said).alias("description"), F.substring("raw_text", at, n).alias("evidence"), F.lit(sure).cast("double").alias("confidence"))
    body = F.to_json(
        F.struct(
            F.lit("Writes").alias("throughline"),
            F.array(F.substring("raw_text", 9, 50), F.substring("raw_text", 9, 50)).alias("throughline_evidence"),
            F.array(claim("Writes at length", 1, 60, 0.95), claim("Built a team of writers", 31, 55, None)).alias("departures"),
            F.array(claim("Keeps notes", 61, 50, 0.0), claim("Keeps more notes", 5, 30, -0.5)).alias("pursuits"),
        )
    )
    return d, d.select("profile_id", body.alias("content"))


def dialect_differences(spark, sf_dir):
    """Where the text rules and the page's come to different results."""
    found = dialects.differences_between(*_doubted(spark, sf_dir)).filter("field <> 'headline'")
    number = lambda c: F.col(c).cast("double")
    return found.select("profile_id", "field", number("before").alias("by_text"), number("now").alias("by_page"))


QUERIES = {
    f.__name__: f
    for f in (
        pdf_texts, entity_texts, naming_turns, nested_records, page_requests, account_failures, gate_passages, career_claims, career_arcs, career_fits,
        career_briefs, career_prompts, date_forms, document_people, guarded_turns, dialect_differences,
    )
}

_WHITE = r"[\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


# The gate's lists, written out once more for the SQL.
_LISTS = (
    ("intent", "seeking|seeks|seek |wants to|want to|looking for|looking to|hopes to|hoping to|aims to|aiming to|aspires|is pursuing|pursuing a|intends to|would like to|ready to|eager to|open to"),
    ("departure", "left|leaving|departed|moved away|moved on|stepped away|stepped back|exited|quit|walked away|gave up|abandoned|moved from|transitioned from|shifted from|away from"),
    ("leadership", "lead|led|manage|managing|head of|heads|director|supervis|mentor|built a team|hired|reports"),
    (
        "consequence",
        "because|due to|as a result|resulted in|led to|caused|prompted|impact|affect|lingering|legacy of|in the wake of|shaped by|frustrated|burned out|burnt out|"
        "demorali|disillusioned|tired of|weary|resent|bitter|scarred|soured|jaded",
    ),
)


def _holds(x: str, words: str) -> str:
    return f"regexp_matches(' ' || regexp_replace(lower({x}), '{_WHITE}+', ' ', 'g') || ' ', '{words}')"


def _rule(claim: str, quote: str) -> str:
    numbers = lambda x: f"regexp_extract_all(replace({x}, ',', ''), '[0-9]+')"
    whens = "".join(f" WHEN {_holds(claim, w)} AND NOT {_holds(quote, w)} THEN '{n}'" for n, w in _LISTS)
    return (
        f"CASE WHEN {claim} = '' OR {quote} = '' THEN 'empty'{whens} "
        f"WHEN len(list_filter({numbers(claim)}, lambda n: NOT list_contains({numbers(quote)}, n))) > 0 THEN 'numbers' ELSE 'ok' END"
    )


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _kind(x: str) -> str:
    quoted = lambda p: p.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{quoted(p)}') THEN '{kind}'" for p, kind in V.MESSAGES) + " END"


def _picked(i: int) -> str:
    return "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{g[i]}'" for k, g in enumerate(GATED)) + " END"


_WEAK = (
    "senior staff principal lead head chief director manager assistant associate consultant coordinator specialist executive officer partner founder "
    "vp inc llc ltd the and for via at of to from into moved left toward towards work working role roles career job jobs then now later"
).split()
_ENDINGS = "ational|ization|isation|ators|ation|ition|ement|ments|ment|ering|ings|ator|ing|ors|ers|ies|ion|ist|or|er|ed|es|s"


def _stems(x: str) -> str:
    weak = "[" + ", ".join(f"'{w}'" for w in _WEAK) + "]"
    words = f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9+#]+')), lambda w: length(w) > 2 AND NOT list_contains({weak}, w))"
    cut = f"list_transform({words}, lambda w: regexp_replace(w, '^(.{{3,}}?)(?:{_ENDINGS})$', '\\1'))"
    return f"list_distinct(list_transform({cut}, lambda c: CASE WHEN rtrim(c, 'e') = '' THEN c ELSE rtrim(c, 'e') END))"


_CAREERS = """
s AS (SELECT o_custkey AS id, o_orderstatus AS st, year(min(o_orderdate)) AS a, year(max(o_orderdate)) AS z, count(*) AS n FROM orders GROUP BY ALL),
w AS (SELECT DISTINCT id, b.a AS ba, b.z AS bz, t.a AS ta, p.a AS pa, p.z AS pz, p.n AS pn FROM (SELECT DISTINCT id FROM s) i
  LEFT JOIN (FROM s WHERE st = 'F') b USING (id) LEFT JOIN (FROM s WHERE st = 'O') t USING (id) LEFT JOIN (FROM s WHERE st = 'P') p USING (id)),
c AS (
  SELECT id, 'departures' AS kind, 0 AS pos, 0.8::DOUBLE AS conf, CASE WHEN ba IS NULL THEN 'unverified' WHEN ta < ba THEN 'contradicts_dates' WHEN ba < ta THEN 'kept'
    WHEN coalesce(ta >= bz, false) OR coalesce(pa >= bz, false) THEN 'kept' ELSE 'unsupported' END AS outcome FROM w
  UNION ALL SELECT id, 'departures', 1, 0.6::DOUBLE, CASE WHEN pa IS NULL THEN 'unverified'
    WHEN coalesce(ta >= pz, false) OR coalesce(ba >= pz, false) THEN 'kept' ELSE 'unsupported' END FROM w
  UNION ALL SELECT id, 'pursuits', 0, 0.8::DOUBLE, CASE WHEN ta IS NULL THEN 'unverified' ELSE 'kept' END FROM w
  UNION ALL SELECT id, 'pursuits', 1, 0.6::DOUBLE, CASE WHEN pa IS NULL THEN 'unverified' WHEN pz - pa + 1 = pn THEN 'kept' ELSE 'unsupported' END FROM w)"""

_SCORED = f"""
{_CAREERS},
k AS (SELECT id, count(*) FILTER (outcome = 'kept') AS kept, list(conf ORDER BY kind, pos) FILTER (outcome = 'kept') AS confs,
        count(DISTINCT CASE WHEN outcome = 'kept' THEN kind || pos END) AS quotes FROM c GROUP BY id),
r AS (SELECT *, (4 - kept) / 4::DOUBLE AS d, CASE WHEN kept > 0 THEN kept / 4::DOUBLE * least(1::DOUBLE, quotes / 4::DOUBLE)
        * (list_reduce(list_prepend(0::DOUBLE, confs), lambda x, y: x + y) / kept) ELSE 0 END AS s FROM k),
arc AS (SELECT id, kept, {half_even('d', 3)} AS drop_rate, {half_even('s', 2)} AS confidence FROM r),
told AS (SELECT id, 'Somebody'
    || CASE WHEN ta IS NULL THEN '' ELSE chr(10) || 'Teacher at North School' || chr(10) || ta || ' - Present' || chr(10) || '{CLASS}.' END
    || CASE WHEN ba IS NULL THEN '' ELSE chr(10) || 'Baker at Corner Bakery' || chr(10) || ba || ' - ' || bz || chr(10) || '{OVENS}.' END
    || CASE WHEN pa IS NULL THEN '' ELSE chr(10) || 'Sailor on river boats' || chr(10) || pa || ' - ' || pz || chr(10) || 'Led a crew of ' || pn || ' on the long river run.' END AS raw_text FROM w)"""

_ASSESSED = f"""
{_SCORED},
f AS (SELECT id, id % 3 + 1 AS role_id, id % 11 = 0 AS thoughtless, id % 7 = 0 AS sends, confidence, kept,
        CASE id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN true END AS said FROM arc),
v AS (SELECT *, said IS NOT NULL AND confidence < 0.45 AS withheld, CASE WHEN confidence >= 0.45 THEN said END AS verdict FROM f)"""

_DOUBTED = f"""
d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 120),
q AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS i, unnest(['departures.0', 'departures.1', 'pursuits.0', 'pursuits.1']) AS field,
        unnest([substr(text, 1, 60), substr(text, 31, 55), substr(text, 61, 50), substr(text, 5, 30)]) AS e, unnest([0.95, NULL, 0.0, -0.5]::DOUBLE[]) AS sure,
        lower(trim(regexp_replace(translate(text, '’‘“”', '''''""'), '{_WHITE}+', ' ', 'g'), ' ')) AS hay FROM d),
n AS (SELECT *, lower(trim(regexp_replace(trim(regexp_replace(translate(e, '’‘“”', '''''""'), '{_WHITE}+', ' ', 'g'), ' '), '^(\\.\\.\\.|…)+|(\\.\\.\\.|…)+$', '', 'g'),
        ' ' || chr(9) || chr(10) || chr(13) || '"''“”‘’.,;:-—–')) AS needle FROM q),
k AS (SELECT *, length(needle) >= 12 AND contains(hay, needle) AS stands, CASE WHEN length(needle) >= 40 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS ceiling,
        i = 1 AND NOT {_holds('e', dict(_LISTS)['leadership'])} AS unled FROM n),
b AS (SELECT *, CASE WHEN stands AND NOT unled THEN greatest(0::DOUBLE, least(coalesce(sure, 0.6::DOUBLE), ceiling)) END AS t,
        CASE WHEN stands THEN least(CASE WHEN sure IS NULL OR sure = 0 THEN 0.5::DOUBLE ELSE sure END, ceiling) END AS p FROM k),
c AS (SELECT doc_id, count(t) AS tn, count(p) AS pn, count(DISTINCT CASE WHEN t IS NOT NULL THEN needle END) AS td, count(DISTINCT CASE WHEN p IS NOT NULL THEN needle END) AS pd,
        coalesce(list_reduce(list_prepend(0::DOUBLE, list(t ORDER BY i) FILTER (t IS NOT NULL)), lambda x, y: x + y), 0) AS ts,
        coalesce(list_reduce(list_prepend(0::DOUBLE, list(p ORDER BY i) FILTER (p IS NOT NULL)), lambda x, y: x + y), 0) AS ps FROM b GROUP BY doc_id),
g AS (SELECT doc_id, coalesce(tn / 4::DOUBLE * least(1::DOUBLE, td / 4::DOUBLE) * (ts / nullif(tn, 0)), 0) AS t, coalesce(least(1::DOUBLE, pd / 4::DOUBLE) * (ps / nullif(pn, 0)), 0) AS p FROM c)"""

ORACLE_SQL = {
    "pdf_texts": f"""
WITH d AS (SELECT doc_id, doc_id % 6 >= 4 OR {_stripped("coalesce(text, '')")} = '' AS out, {_stripped("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, CASE WHEN NOT out THEN md5(t) END AS digest, CASE WHEN out THEN 'no text in the PDF' END AS reason FROM d""",
    "entity_texts": "SELECT doc_id, md5(text) AS digest FROM documents WHERE NOT regexp_matches(text, 'ß[0-9a-fA-F;]')",
    "naming_turns": f"""
WITH i AS (SELECT stem, count(*) AS spans FROM (SELECT unnest({_stems('substr(text, 1, 40)')}) AS stem FROM benchmark) GROUP BY stem),
c AS (SELECT conv_id * 1000 + turn AS claim_id, unnest({_stems('substr(text, 1, 60)')}) AS stem FROM conversations WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY spans, stem) AS n FROM c JOIN i USING (stem))
SELECT claim_id, stem, spans FROM r WHERE n = 1""",
    "nested_records": """
WITH e AS (SELECT *, event_id % 3 = 0 AS deep FROM events WHERE event_id % 7 = 0)
SELECT event_id, CASE WHEN deep THEN repeat('in.', 20) ELSE '' END || 'k' AS path, json_extract_string(props, '$.k') AS value FROM e
UNION ALL SELECT event_id, repeat('in.', 19) || 'type', event_type FROM e WHERE deep""",
    "page_requests": rf"""
WITH p AS (SELECT *, regexp_replace(url, '^https?://(www\.)?', '') AS bare FROM pages),
k AS (SELECT *, lower(regexp_extract(bare, '^[^/?#]*')) || rtrim(regexp_extract(bare, '^[^/?#]*([^?#]*)', 1), '/') || regexp_extract(bare, '(\?[^#]*)', 1) AS address FROM p),
asked AS (SELECT page_id AS asker, CASE WHEN page_id % 5 = 4 THEN lower(regexp_extract(bare, '^[^/?#]*')) || regexp_extract(bare, '^[^/?#]*([^?#]*)', 1) || '/none'
    ELSE address END AS wanted FROM k),
held AS (SELECT address, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM k GROUP BY address),
t AS (SELECT asker, page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'),
    '<[^>]+>', ' ', 'g'), '{_WHITE}{{2,}}', ' ', 'g'), ' ')) AS n FROM asked LEFT JOIN held ON wanted = address)
SELECT asker, CASE WHEN n >= 80 THEN page_id END AS page_id, CASE WHEN n >= 80 THEN n END AS n,
       CASE WHEN page_id IS NULL THEN 'not fetched' WHEN n < 80 THEN 'no readable text on the page' END AS reason FROM t""",
    "account_failures": """
WITH c AS (SELECT c_name AS login, c_custkey AS k, CASE c_custkey % 11 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 502 ELSE 200 END AS own,
  CASE c_custkey % 13 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 502 ELSE 200 END AS list FROM customer),
f AS (SELECT *, CASE WHEN own >= 400 THEN own WHEN list >= 400 THEN list END AS bad FROM c)
SELECT login, CASE WHEN bad IS NULL THEN login END AS name, CASE WHEN bad IS NULL THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END END::BIGINT AS repos,
       CASE bad WHEN 404 THEN 'no such account' WHEN 403 THEN 'rate limit reached' WHEN 502 THEN 'service failed' END AS reason FROM f""",
    "gate_passages": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, {_stripped(_picked(0) + " || ' ' || substr(text, 1, 50)")} AS claim,
        {_stripped("CASE WHEN doc_id % 2 = 0 THEN " + _picked(1) + " ELSE '' END || ' ' || substr(text, 51, 90)")} AS quote FROM t)
SELECT doc_id, {_rule('claim', 'quote')} AS rule FROM p""",
    "career_claims": f"""
WITH {_CAREERS} SELECT id AS profile_id, kind, CAST(pos AS INT) AS pos, outcome, CASE WHEN outcome = 'kept' THEN conf END AS confidence FROM c""",
    "career_arcs": f"""
WITH {_SCORED} SELECT id AS profile_id, 4::BIGINT AS proposed, kept, drop_rate, confidence,
  concat_ws('|', CASE WHEN ta IS NOT NULL THEN '{CLASS}' END, CASE WHEN ba IS NOT NULL THEN '{OVENS}' END) AS headline FROM arc JOIN w USING (id)""",
    "career_fits": f"""
WITH {_ASSESSED},
t AS (SELECT v.*, list_filter(list_distinct(regexp_extract_all(lower(raw_text), '{V.TERM}')), lambda x: NOT list_contains({_words(V.STOPWORDS)}, x)) AS a,
        list_filter(list_distinct(regexp_extract_all(lower(CASE role_id {" ".join(f"WHEN {i} THEN '{text}'" for i, _, text in ROLES)} END), '{V.TERM}')),
          lambda x: NOT list_contains({_words(V.STOPWORDS)}, x)) AS b FROM v JOIN told USING (id)),
m AS (SELECT *, list_sort(list_filter(b, lambda x: list_contains(a, x))) AS both_, len(b) AS n FROM t),
q AS (SELECT *, len(both_) / n::DOUBLE AS share FROM m)
SELECT id AS profile_id, role_id, CASE WHEN NOT thoughtless THEN verdict END AS continues_arc, CASE WHEN NOT thoughtless THEN withheld END AS withheld,
       CASE WHEN NOT thoughtless THEN CAST(2 + withheld::INT AS BIGINT) END AS flags, CASE WHEN NOT thoughtless THEN array_to_string(both_, ' ') END AS shared,
       CASE WHEN NOT thoughtless THEN {half_even('share', 3)} END AS ratio, CASE WHEN thoughtless THEN 'no_reasoning' END AS failure FROM q""",
    "career_briefs": f"""
WITH {_ASSESSED},
c2 AS (SELECT *, list_filter([
    CASE WHEN sends THEN 'The role rationale was withheld: it held a salutation.' END,
    CASE WHEN kept = 0 THEN 'No claim was borne out by the profile''s text; arc confidence is 0.0. Take the story as a guess and read the profile.'
         WHEN confidence < 0.6 THEN 'Arc confidence is ' || confidence || ', below 0.6: a hypothesis from ' || kept || ' verified quote(s).' END,
    CASE WHEN verdict IS NULL THEN 'No verdict: the evidence doesn''t settle whether the role continues the arc.'
         WHEN NOT verdict THEN 'The role seems to break with the arc. Say so openly if you go on.' END,
    'No unresolved tension was found; the open question is generic.',
    CASE WHEN withheld THEN 'No verdict stands on an arc with confidence ' || confidence || ' (the floor is 0.45); one was offered.' END,
    'far', 'A risk flag was withheld: it read as a message to the candidate.'], lambda x: x IS NOT NULL) AS said_first FROM v WHERE NOT thoughtless)
SELECT id AS profile_id, role_id, 'Customer ' || id || ' [needs_human_message]' || chr(10)
    || array_to_string(list_transform(said_first, lambda x, i: i || '. ' || x), chr(10)) || chr(10) || 'Story: Kept moving on' || chr(10)
    || 'Role: ' || CASE WHEN sends THEN 'held back, as the cautions say' ELSE 'So it seems' END || chr(10)
    || 'Ask: What would make the next move worth it? (No tension was found in the profile: ask, don''t assume.)' AS text FROM c2""",
    "career_prompts": f"""
WITH {_SCORED},
l AS (SELECT id, unnest([ta, ba, pa]) AS a, unnest([9999, bz, pz]) AS z, unnest([0, 1, 2]) AS i, unnest(['Teacher at North School', 'Baker at Corner Bakery', 'Sailor on river boats']) AS label FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) = 1 AS top FROM l WHERE a IS NOT NULL),
d AS (SELECT id, string_agg(a || '-' || CASE WHEN z = 9999 THEN 'present' ELSE z::VARCHAR END || ': ' || CASE WHEN top THEN 'Somebody — ' ELSE '' END || label, chr(10) ORDER BY a, z, i) AS dates FROM n GROUP BY id)
SELECT id AS profile_id, 'Only what stands between the rulers may be quoted.' || chr(10) || repeat('=', 40) || chr(10) || raw_text || chr(10) || repeat('=', 40) || chr(10) || '[who]' || chr(10) || 'Ada'
  || chr(10) || '[roles]' || chr(10) || 'Baker; Sailor' || chr(10) || '[from]' || chr(10) || 'orders' || chr(10) || '[dates]' || chr(10) || dates AS prompt
FROM told JOIN d USING (id)""",
    "date_forms": """
SELECT o_orderkey, 'Desk ' || o_orderstatus || CASE WHEN o_orderkey % 7 = 5 THEN ', Old Mill' ELSE '' END AS label, CAST(year(o_orderdate) AS INT) AS start,
       CASE WHEN o_orderkey % 7 NOT IN (4, 6) THEN CAST(year(o_orderdate) + o_orderkey % 4 AS INT) END AS stop,
       CAST(CASE o_orderkey % 7 WHEN 5 THEN 2 WHEN 6 THEN 4 ELSE 3 END AS INT) AS line FROM orders""",
    "document_people": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'linkedin.com/in/ada-' || doc_id || ' and LinkedIn.com/in/Bo_' || doc_id
    WHEN 1 THEN chr(10) || 'Mail a' || doc_id || '@b.org or C' || doc_id || '@d.org'
    WHEN 2 THEN chr(10) || 'Experience' || chr(10) || 'x' || chr(10) || ' Education:' || chr(10) || 'y' || chr(10) || 'experience' || chr(10) || 'z' || chr(10) || 'EDUCATION' ELSE '' END AS t FROM documents),
e AS (SELECT doc_id, doc_id % 5 = 0 AS handled, list_distinct(list_transform(regexp_extract_all(t, '{V.EMAIL}'), lambda x: lower(x))) AS found,
        list_transform(regexp_extract_all(t, '{V.EMAIL}'), lambda x: lower(x)) AS every,
        list_filter(list_transform(string_split(regexp_replace(t, '{V.LINE_END}', chr(10), 'g'), chr(10)), lambda x: lower(trim({_stripped('x')}, ':'))),
          lambda x: list_contains({_words("contact|top skills|skills|experience|education|summary|about|certifications|licenses|honors|publications".split("|"))}, x)) AS heads FROM t),
p AS (SELECT *, list_sort(list_distinct(list_filter(heads, lambda x: len(list_filter(heads, lambda y: y = x)) > 1))) AS twice,
        list_filter(every, lambda x, i: list_position(every, x) = i) AS ordered FROM e)
SELECT doc_id, NOT handled AND len(found) < 2 AND len(twice) < 2 AS ok, CASE WHEN handled THEN 'handles' WHEN len(found) > 1 THEN 'emails' WHEN len(twice) > 1 THEN 'sections' END AS reason,
       CASE WHEN handled THEN 'linkedin.com/in/ada-' || doc_id || '|linkedin.com/in/bo_' || doc_id WHEN len(found) > 1 THEN array_to_string(ordered, '|')
            WHEN len(twice) > 1 THEN array_to_string(twice, '|') ELSE '' END AS evidence FROM p""",
    "guarded_turns": f"""
WITH c AS (SELECT conv_id, turn, text, 'Hi Ada, would you be open to it? No. ' || turn AS cited, CASE WHEN turn % 3 = 1 THEN '" Let me know if you agree' ELSE '"' END AS rest FROM conversations),
s AS (SELECT *, text || ' He wrote: "' || cited || rest AS said, replace(text || ' He wrote: "' || cited || rest, cited, ' [quoted] ') AS bare,
        replace(text || ' He wrote: "' || cited || rest, cited, '') AS cut FROM c)
SELECT conv_id, turn, {_kind('said')} AS kind, {_kind('bare')} AS kind_without, md5(CASE WHEN {_kind('cut')} IS NULL THEN cut ELSE 'held' END) AS kept FROM s""",
    "dialect_differences": f"""
WITH {_DOUBTED},
every AS (SELECT doc_id, field, {half_even('t', 2)} AS t, CASE WHEN p IS NULL THEN NULL ELSE floor(p * 100 + 0.5) / 100 END AS p FROM b
  UNION ALL SELECT doc_id, 'score', {half_even('t', 2)}, floor(p * 100 + 0.5) / 100 FROM g)
SELECT doc_id AS profile_id, field, t AS by_text, p AS by_page FROM every WHERE t IS DISTINCT FROM p""",
}
