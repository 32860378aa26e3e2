"""Queries over hand-written cases, one case per customer, and over tables made from orders and
parts; with their SQL, which holds the cases' expected values or computes them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.functions import confidence, guard, identity, responses, timeline
from vouchwell.functions.gate import gate
from vouchwell.functions.text import strip_thinking
from vouchwell.operators import brief, fit, profile_lines, prompts, records
from vouchwell.plans import cases as C
from vouchwell.plans import pipeline
from vouchwell.plans.queries import keyed, spread
from vouchwell.sources import accounts, decode, files, intake


def _table(spark, sf_dir, name, *columns) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns or "*")


def dealt(spark, sf_dir, rows, schema: str, spread=spread) -> DataFrame:
    """Every customer with the case that its key comes to, and its name put in."""
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    customers = spread(_table(spark, sf_dir, "customer", "c_custkey", "c_name"))
    met = customers.join(F.broadcast(table), F.pmod("c_custkey", F.lit(len(rows))) == F.col("_i"))
    named = lambda f: F.replace(f.name, F.lit("{name}"), F.col("c_name")) if f.dataType.typeName() == "string" else F.col(f.name)
    return met.select("c_custkey", "c_name", *[named(f).alias(f.name) for f in table.schema if f.name != "_i"])


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def expected(n: int, rows, names: str) -> str:
    """The expected rows (place of the case first) of all customers, as SQL."""
    columns = names.split()
    texts = {c for k, c in enumerate(columns, 1) if any(isinstance(r[k], str) for r in rows)}
    shown = [f"replace({c}, '{{name}}', c_name) AS {c}" if c in texts else f'"{c}"' for c in columns]
    values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    quoted = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT c_custkey, {', '.join(shown)} FROM customer JOIN (VALUES {values}) AS e(_i, {quoted}) ON c_custkey % {n} = _i"


def _each(rows, first: int) -> list[tuple]:
    """Cases with one expected row each: the values from ``first`` on."""
    return [(i, *r[first:]) for i, r in enumerate(rows)]


def _many(rows) -> list[tuple]:
    """Cases whose last value is a list of expected rows."""
    return [(i, *x) for i, (*_, found) in enumerate(rows) for x in found]


def gate_cases(spark, sf_dir):
    """The gate with its own word lists, by substrings and by whole words."""
    d = dealt(spark, sf_dir, [r[:2] for r in C.GATE], "claim string, quote string")
    c, q = F.col("claim"), F.col("quote")
    return d.select("c_custkey", gate(c, q)["rule"].alias("rule"), gate(c, q, whole_words=True)["rule"].alias("whole_rule"))


def span_cases(spark, sf_dir):
    """Every form of a date line, and what isn't one."""
    d = dealt(spark, sf_dir, [r[:1] for r in C.SPANS], "text string")
    return d.select("c_custkey", F.explode(timeline.spans(F.col("text"))).alias("s")).select("c_custkey", "s.label", "s.start", F.col("s.end").alias("stop"), "s.line")


def year_cases(spark, sf_dir):
    """Years of two digits."""
    return dealt(spark, sf_dir, [r[:1] for r in C.YEARS], "text string").select("c_custkey", timeline.four_digit_years(F.col("text")).alias("years"))


def word_cases(spark, sf_dir):
    """Are two words forms of one?"""
    d = dealt(spark, sf_dir, [r[:2] for r in C.WORDS], "a string, b string")
    return d.select("c_custkey", timeline.same_word(F.col("a"), F.col("b")).alias("same"))


def move_cases(spark, sf_dir):
    """Spans that a claim names, and whether the record bears out its order."""
    s, c = timeline.spans(F.col("record")), F.col("claim")
    d = dealt(spark, sf_dir, [(r[0], C.RECORD) for r in C.MOVES], "claim string, record string")
    return d.select(
        "c_custkey", F.size(timeline.matching(c, s)).alias("named"), timeline.confirms_order(c, s).alias("confirmed"), timeline.contradicts_order(c, s).alias("contradicted")
    )


def departure_cases(spark, sf_dir):
    """The role that a quote stands under, and whether the record shows that it ended."""
    s, q, r = timeline.spans(F.col("record")), F.col("quote"), F.col("record")
    d = dealt(spark, sf_dir, [(r[0], C.RECORD) for r in C.DEPARTURES], "quote string, record string")
    return d.select("c_custkey", timeline.owning_span(q, s, r)["label"].alias("owner"), timeline.proves_departure(q, s, r).alias("proved"))


def person_cases(spark, sf_dir):
    """One person or two?"""
    d = dealt(spark, sf_dir, [r[:1] for r in C.PEOPLE], "text string").select("c_custkey", identity.one_person(F.col("text")).alias("p"))
    return d.select("c_custkey", F.col("p.reason").alias("reason"), F.array_join("p.evidence", "|").alias("evidence"))


def export_cases(spark, sf_dir):
    """An export's text put together again without its furniture."""
    d = dealt(spark, sf_dir, [r[:1] for r in C.EXPORTS], "text string").select("c_custkey", "text")
    s = profile_lines.strip_furniture(d, "c_custkey", "text")
    return s.select("c_custkey", "text", F.array_join("removed", "|").alias("removed"))


def guard_cases(spark, sf_dir):
    """Sendable text without and with its quotes exempt, refused, and in quarantine."""
    d = dealt(spark, sf_dir, [r[:2] for r in C.GUARDED], "text string, cited string")
    t = F.col("text")
    left = guard.quarantine(t, "(held back)")["value"]
    kind, bare = guard.sendable_kind(t), guard.sendable_kind(t, F.array("cited"))
    passed = F.when(kind.isNull(), guard.reject_sendable(t))
    return d.select("c_custkey", kind.alias("kind"), bare.alias("kind_without"), left.alias("quarantined"), passed.alias("passed"))


def response_cases(spark, sf_dir):
    """The object of a recorded response and its fields."""
    d = dealt(spark, sf_dir, [r[:1] for r in C.READ], "content string")
    j = responses.json_object(strip_thinking(F.col("content")))
    x = responses.field(F.col("j.data"), "x")
    return d.select("c_custkey", j.alias("j")).select(
        "c_custkey",
        F.col("j.failure").alias("failure"),
        responses.as_text(x).alias("said"),
        F.array_join(responses.strings(F.col("j.data"), "x"), "|").alias("strings"),
        responses.verdict(x).alias("verdict"),
    )


def _profiles(spark, sf_dir):
    d = dealt(spark, sf_dir, [(C.PROFILE, r, f) for r, f in zip(C.RESPONSES, C.FITS)], "raw_text string, content string, fit string", lambda c: keyed(c, "c_custkey"))
    none = F.lit(None)
    profiles = d.select(
        F.col("c_custkey").alias("profile_id"), "raw_text", F.col("c_name").alias("name"), F.array(F.lit("Baker"), F.lit("Teacher")).alias("known_roles"), none.cast("string").alias("source_notes")
    )
    said = d.select(F.col("c_custkey").alias("profile_id"), "content")
    role = spark.createDataFrame([(1, "Baker", C.ROLE, None)], "role_id long, title string, raw_description string, company_context string")
    fits = d.select(F.col("c_custkey").alias("profile_id"), F.lit(1).cast("long").alias("role_id"), F.col("fit").alias("content"))
    return profiles, said, role, fits


def _run(spark, sf_dir):
    profiles, said, role, fits = _profiles(spark, sf_dir)
    return pipeline.run(profiles, said, role, fits)


def kept_cases(spark, sf_dir):
    """Claims that stand, one of them by the record's dates."""
    k = _run(spark, sf_dir).kept
    return k.select(F.col("profile_id").alias("c_custkey"), "kind", F.col("pos").alias("place"), "description", "confidence")


def dropped_cases(spark, sf_dir):
    """Claims that fail, each for its reason."""
    d = _run(spark, sf_dir).drops
    return d.select(F.col("profile_id").alias("c_custkey"), "kind", F.col("pos").alias("place"), "reason", "rule", "overlap")


def arc_cases(spark, sf_dir):
    """Headline quotes, counts and derived confidence."""
    a = _run(spark, sf_dir).arcs
    return a.select(
        F.col("profile_id").alias("c_custkey"), F.array_join("throughline_evidence", "|").alias("headline"), F.array_join("tension_evidence", "|").alias("tension"),
        "proposed", "kept", "drop_rate", "confidence",
    )


def failure_cases(spark, sf_dir):
    """Responses that can't be used."""
    return _run(spark, sf_dir).failures.select(F.col("profile_id").alias("c_custkey"), "failure")


def fit_cases(spark, sf_dir):
    """Verdicts on a role, withheld on a thin arc."""
    f = _run(spark, sf_dir).fits
    return f.select(
        F.col("profile_id").alias("c_custkey"), "continues_arc", "withheld", F.size("risk_flags").alias("flags"), F.array_join("skill_overlap.matched", " ").alias("shared")
    )


def brief_cases(spark, sf_dir):
    """The whole run, to the text that a human reads."""
    b = brief.render(brief.reject_violations(_run(spark, sf_dir).briefs))
    return b.select(F.col("profile_id").alias("c_custkey"), "text")


def story_prompt_cases(spark, sf_dir):
    """What a model would be shown of a profile."""
    p = prompts.story_prompts(_profiles(spark, sf_dir)[0])
    return p.select(F.col("profile_id").alias("c_custkey"), "prompt")


def fit_prompt_cases(spark, sf_dir):
    """What a model would be shown of an arc and a role."""
    profiles, said, role, _ = _profiles(spark, sf_dir)
    arcs = pipeline.verify(profiles, said).arcs
    p = prompts.fit_prompts(arcs, role, fit.pair_up(profiles, role))  # pairs without an arc have no prompt: arcs are computed once
    return p.select(F.col("profile_id").alias("c_custkey"), "prompt")


def completion_cases(spark, sf_dir):
    """Landed completions, and why one has no content."""
    d = dealt(spark, sf_dir, [r[:2] for r in C.COMPLETIONS], "status int, body string")
    b = F.col("body")
    return d.select("c_custkey", prompts.completion_failure(F.col("status"), b).alias("failure"), prompts.completion_content(b).alias("content"))


def pdf_head_cases(spark, sf_dir):
    """Is a file a PDF?"""
    d = dealt(spark, sf_dir, [r[:1] for r in C.HEADS], "head string")
    return d.select("c_custkey", decode.looks_like_pdf(F.encode("head", "UTF-8")).alias("pdf"))


def request_cases(spark, sf_dir):
    """A list of sources taken apart."""
    d = dealt(spark, sf_dir, [r[:1] for r in C.REQUESTS], "entry string").select("c_custkey", "entry")
    r = files.parse_requests(d, "c_custkey", "entry")
    return r.select("c_custkey", F.col("pos").alias("place"), "token", "kind", "login")


def account_texts(spark, sf_dir):
    """Account and repository bodies, as landed, to profile texts."""
    account = F.struct(
        F.col("c_name").alias("login"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit(" bakes ")).alias("bio"),
        F.lit("2009-01-02").alias("created_at"),
        F.col("c_nationkey").alias("public_repos"),
    )
    landing = _table(spark, sf_dir, "customer").select(F.to_json(account).alias("body"))
    begun = F.date_format("o_orderdate", "yyyy-MM-dd")
    pushed = F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 700).cast("int")), "yyyy-MM-dd")
    repo = F.struct(
        F.concat(F.lit("r"), F.col("o_orderkey")).alias("name"),
        F.col("o_orderpriority").alias("language"),
        (F.col("o_orderkey") % 3).alias("stargazers_count"),
        (F.col("o_orderstatus") == "P").alias("fork"),
        begun.alias("created_at"),
        pushed.alias("pushed_at"),
    )
    owned = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    repos = accounts.landed(owned.select(F.col("c_name").alias("login"), F.to_json(repo).alias("body")), "body", accounts.REPO_JSON)
    found = accounts.profile_texts(accounts.landed(landing, "body", accounts.ACCOUNT_JSON), accounts.recent_repos(repos), F.lit("2026-01-01"))
    return found.select("login", "name", F.md5("raw_text").alias("digest"), "source_notes")


def part_roles(spark, sf_dir):
    """Roles with and without a title, and the refused."""
    short = F.col("p_partkey") % 5 == 0
    said = F.when(short, F.lit(" abc ")).otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit("\n"), F.repeat("p_type", (F.col("p_partkey") % 4).cast("int"))))
    rows = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("role_id"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.lit(" ")).alias("title"),
        F.when(F.col("p_partkey") % 7 == 0, F.repeat("p_type", F.lit(9))).otherwise(said).alias("raw_description"),
        F.lit("").alias("company_context"),
    )
    kept, out = intake.load_roles(rows)
    none = F.lit(None).cast("string")
    a = kept.select("role_id", "title", F.length("raw_description").cast("long").alias("n"), none.alias("reason"))
    return a.unionByName(out.select("role_id", none.alias("title"), F.col("n_chars").cast("long").alias("n"), "reason"))


def nation_sources(spark, sf_dir):
    """Several sources of one owner as one text."""
    n = _table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("path"), F.concat(F.lit("About "), F.col("n_name")).alias("text"))
    return files.joined_sources(n, "n_regionkey")


def page_texts(spark, sf_dir):
    """Fetched pages that have enough text, and the refused."""
    p = _table(spark, sf_dir, "pages", "page_id", "html")
    kept, out = files.fetched_pages(p, "page_id", "html")
    a = kept.select("page_id", F.length("text").cast("long").alias("n"), F.lit(None).cast("string").alias("reason"))
    return a.unionByName(out.select("page_id", F.lit(None).cast("long").alias("n"), "reason"))


def order_graph(spark, sf_dir):
    """Nodes around their centre and the edges to it, for a customer's orders as claims."""
    claims = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") / 300000).alias("confidence")
    )
    nodes, edges = records.graph(claims)
    both = nodes.join(edges, (nodes["profile_id"] == edges["profile_id"]) & (nodes["node"] == edges["b"]))
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return both.select(nodes["profile_id"], "node", "kind", "a", F.round(far, 2).alias("far"), (F.round("x", 2) + 0.0).alias("x"))


def segment_scores(spark, sf_dir):
    """A4: the score without the share of claims that held, by customer segment."""
    c = _table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count_if(F.col("c_acctbal") > 0).alias("kept"), F.count_distinct("c_nationkey").alias("distinct"), F.lit(0.5).alias("mean")
    )
    return c.select("c_mktsegment", confidence.coverage_score(F.col("kept"), F.col("distinct"), F.col("mean")).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        gate_cases, span_cases, year_cases, word_cases, move_cases, departure_cases, person_cases, export_cases, guard_cases, response_cases,
        kept_cases, dropped_cases, arc_cases, failure_cases, fit_cases, brief_cases, story_prompt_cases, fit_prompt_cases, completion_cases,
        pdf_head_cases, request_cases, account_texts, part_roles, nation_sources, page_texts, order_graph, segment_scores,
    )
}


def _brief(*cautions: str, story: str, why: str, ask: str) -> str:
    said = "".join(f"{i}. {c}\n" for i, c in enumerate(cautions, 1))
    return f"{{name}} [needs_human_message]\n{said}Story: {story}\nRole: {why}\nAsk: {ask}"


_ASK = "What would make the next move worth it? (No tension was found in the profile: ask, don't assume.)"
BRIEFS = [
    (
        0,
        _brief(
            "The role rationale was withheld: it held a salutation.",
            "Arc confidence is 0.1, below 0.6: a hypothesis from 2 verified quote(s).",
            "No verdict: the evidence doesn't settle whether the role continues the arc.",
            "No unresolved tension was found; the open question is generic.",
            "No verdict stands on an arc with confidence 0.1 (the floor is 0.45); one was offered.",
            "A risk flag was withheld: it read as a message to the candidate.",
            "long commute",
            story="Makes things others use",
            why="held back, as the cautions say",
            ask=_ASK,
        ),
    ),
    (
        1,
        _brief(
            "The role seems to break with the arc. Say so openly if you go on.", story="Feeds and teaches", why="The role leaves the school behind", ask="School or oven?"
        ),
    ),
    (
        2,
        _brief(
            "No claim was borne out by the profile's text; arc confidence is 0.0. Take the story as a guess and read the profile.",
            "No verdict: the evidence doesn't settle whether the role continues the arc.",
            "No unresolved tension was found; the open question is generic.",
            story="x",
            why="Too little to say",
            ask=_ASK,
        ),
    ),
]
_RULER = "=" * 40
STORY_PROMPT = (
    f"Only what stands between the rulers may be quoted.\n{_RULER}\n{C.PROFILE}\n{_RULER}\n[who]\n{{name}}\n[roles]\nBaker; Teacher\n"
    "[dates]\n2005-2010: Baker — Corner Bakery\n2010-present: Teacher — North School"
)


def _fit_prompt(story, left_open, sure, left, sought):
    beats = lambda found: "\n".join(f'{c} | {d} | "{e}"' for d, e, c in found) or "nothing verified"
    open_ = f"[left open]\n{left_open}\n" if left_open else ""
    return f"[role]\nBaker\n[what it asks]\n{C.ROLE}\n[story so far]\n{story}\n{open_}[how sure (0 to 1)]\n{sure}\n[left behind]\n{beats(left)}\n[sought]\n{beats(sought)}"


FIT_PROMPTS = [
    (0, _fit_prompt("Makes things others use", "", 0.1, [("Left baking", C.DAWN, 0.9)], [("Writes courses", C.MATHS, 0.7)])),
    (
        1,
        _fit_prompt(
            "Feeds and teaches", "School or oven?", 0.72, [("Left the early shifts", C.DAWN, 0.9)],
            [("Writes courses", C.MATHS, 0.9), ("Runs camps", C.CAMP, 0.9), ("Keeps ovens hot", C.OVENS, 0.9)],
        ),
    ),
    (2, _fit_prompt("x", "", 0.0, [], [])),
]

_PASSED = [(i, r[2], r[3], r[4], r[4] if r[2] is None else None) for i, r in enumerate(C.GUARDED)]

ORACLE_SQL = {
    "gate_cases": expected(len(C.GATE), _each(C.GATE, 2), "rule whole_rule"),
    "span_cases": expected(len(C.SPANS), _many(C.SPANS), "label start stop line"),
    "year_cases": expected(len(C.YEARS), _each(C.YEARS, 1), "years"),
    "word_cases": expected(len(C.WORDS), _each(C.WORDS, 2), "same"),
    "move_cases": expected(len(C.MOVES), _each(C.MOVES, 1), "named confirmed contradicted"),
    "departure_cases": expected(len(C.DEPARTURES), _each(C.DEPARTURES, 1), "owner proved"),
    "person_cases": expected(len(C.PEOPLE), _each(C.PEOPLE, 1), "reason evidence"),
    "export_cases": expected(len(C.EXPORTS), _each(C.EXPORTS, 1), "text removed"),
    "guard_cases": expected(len(C.GUARDED), _PASSED, "kind kind_without quarantined passed"),
    "response_cases": expected(len(C.READ), _each(C.READ, 1), "failure said strings verdict"),
    "kept_cases": expected(len(C.RESPONSES), C.KEPT, "kind place description confidence"),
    "dropped_cases": expected(len(C.RESPONSES), C.DROPPED, "kind place reason rule overlap"),
    "arc_cases": expected(len(C.RESPONSES), C.ARCS, "headline tension proposed kept drop_rate confidence"),
    "failure_cases": expected(len(C.RESPONSES), C.FAILURES, "failure"),
    "fit_cases": expected(len(C.RESPONSES), C.VERDICTS, "continues_arc withheld flags shared"),
    "brief_cases": expected(len(C.RESPONSES), BRIEFS, "text"),
    "story_prompt_cases": expected(1, [(0, STORY_PROMPT)], "prompt"),
    "fit_prompt_cases": expected(len(C.RESPONSES), FIT_PROMPTS, "prompt"),
    "completion_cases": expected(len(C.COMPLETIONS), _each(C.COMPLETIONS, 2), "failure content"),
    "pdf_head_cases": expected(len(C.HEADS), _each(C.HEADS, 1), "pdf"),
    "request_cases": expected(len(C.REQUESTS), _many(C.REQUESTS), "place token kind login"),
    "account_texts": r"""
WITH owned AS (
  SELECT c_name AS login, 'r' || o_orderkey AS repo, o_orderpriority AS lang, o_orderkey % 3 AS stars, o_orderstatus = 'P' AS fork,
         strftime(o_orderdate, '%Y-%m-%d') AS begun, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 AS INT), '%Y-%m-%d') AS pushed
  FROM orders JOIN customer ON o_custkey = c_custkey),
recent AS (
  SELECT *, substr(begun, 1, 4) AS y0, substr(pushed, 1, 4) AS y1, row_number() OVER (PARTITION BY login ORDER BY pushed DESC, repo) AS pos FROM owned),
shown AS (SELECT * FROM recent WHERE pos <= 12 AND NOT fork),
langs AS (SELECT login, lang, min(pos) AS seen FROM shown GROUP BY ALL),
written AS (SELECT login, string_agg(lang, ', ' ORDER BY seen) AS said FROM langs GROUP BY login),
listed AS (
  SELECT login, string_agg('- ' || repo || ' (' || y0 || CASE WHEN y0 = y1 THEN '' ELSE ' to ' || y1 END || '), ' || lang
           || CASE WHEN stars > 0 THEN ', ' || stars || ' stars' ELSE '' END, chr(10) ORDER BY pos) AS repos,
         string_agg(repo, ', ' ORDER BY pos) FILTER (y0 <> y1) AS lasting
  FROM shown GROUP BY login),
people AS (
  SELECT c_name AS login, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS name, c_custkey % 2 = 0 AS bakes, c_nationkey FROM customer)
SELECT p.login, name, md5(name || ' (' || p.login || ')' || CASE WHEN bakes THEN chr(10) || 'Bio: bakes' ELSE '' END
    || chr(10) || 'Account opened 2009; public repositories: ' || c_nationkey || '; followers: 0'
    || coalesce(chr(10) || 'Written in: ' || said, '') || coalesce(chr(10) || chr(10) || 'Repositories by last push' || chr(10) || repos, '')
    || coalesce(chr(10) || chr(10) || 'Pushed to in a later year than begun: ' || lasting, '')) AS digest,
  'Source: github.com/' || p.login || ', landed 2026-01-01' AS source_notes
FROM people p LEFT JOIN written USING (login) LEFT JOIN listed USING (login)""",
    "part_roles": r"""
WITH r AS (
  SELECT p_partkey AS role_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS given,
    CASE WHEN p_partkey % 7 = 0 THEN repeat(p_type, 9) WHEN p_partkey % 5 = 0 THEN 'abc'
         ELSE trim(p_name || chr(10) || repeat(p_type, p_partkey % 4), ' ' || chr(10)) END AS said FROM part),
f AS (SELECT *, trim(split_part(said, chr(10), 1)) AS top FROM r)
SELECT role_id, CASE WHEN length(said) >= 8 THEN coalesce(given, CASE WHEN length(top) <= 80 THEN top ELSE rtrim(substr(top, 1, 77)) || '...' END) END AS title,
       CAST(length(said) AS BIGINT) AS n, CASE WHEN said = '' THEN 'empty' WHEN length(said) < 8 THEN 'short' END AS reason FROM f""",
    "nation_sources": """
SELECT n_regionkey, string_agg('About ' || n_name, chr(10) || chr(10) ORDER BY n_name) AS raw_text FROM nation GROUP BY n_regionkey""",
    "page_texts": r"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'),
    '<[^>]+>', ' ', 'g'), '[\s\x{a0}]{2,}', ' ', 'g'), ' ') AS t FROM pages)
SELECT page_id, CASE WHEN length(t) >= 80 THEN length(t) END AS n, CASE WHEN length(t) < 80 THEN 'no readable text on the page' END AS reason FROM t""",
    "order_graph": """
WITH n AS (
  SELECT o_custkey AS profile_id, o_orderstatus AS kind, least(1.0::DOUBLE, greatest(0.15::DOUBLE, o_totalprice / 300000)) AS conf,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS node, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT profile_id, node, kind, 0 AS a, round(420 - 220 * conf, 2) AS far, round((420 - 220 * conf) * cos(2 * pi() * (node - 1) / total), 2) + 0.0::DOUBLE AS x FROM n""",
    "segment_scores": """
SELECT c_mktsegment, CASE WHEN count(*) FILTER (c_acctbal > 0) > 0 THEN least(1.0::DOUBLE, count(DISTINCT c_nationkey) / 4.0::DOUBLE) * 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM customer GROUP BY c_mktsegment""",
}
