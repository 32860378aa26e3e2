"""Hand-written cases, dealt to customers by their key: input columns, then the expected values.

``{name}`` stands for the customer's name. The expected values were worked out by hand from what
each operator is to do; the SQL of these queries holds them, and nothing of the library.
"""

from __future__ import annotations

import json

# claim, quote | the rule that decides: by substrings, by whole words
GATE = [
    ("Wants to teach", "I want to teach one day", "ok", "ok"),
    ("Seeking a research post", "Wrote papers on soil", "intent", "intent"),
    ("Aspires to run a mill", "Ran the mill for a year", "intent", "intent"),
    ("Left banking", "Worked in banking", "departure", "departure"),
    ("Left banking", "I stepped away from banking", "ok", "ok"),
    ("Walked away and gave up the boat", "The boat was sold", "departure", "departure"),
    ("Managed ten people", "Worked with ten people", "leadership", "leadership"),
    ("Mentored the juniors", "Sat near the juniors", "leadership", "ok"),
    ("Burned out by audits", "Did audits for years", "consequence", "consequence"),
    ("Demoralised by cuts", "There were cuts", "consequence", "ok"),
    ("The strike led to cuts", "There were cuts", "leadership", "leadership"),
    ("Sold 1,000 boats", "sold 1000 boats", "ok", "ok"),
    ("Sold 30 boats in 07", "sold 30 boats in 7", "numbers", "numbers"),
    ("", "anything", "empty", "empty"),
    ("anything", None, "empty", "empty"),
    ("Seeking to leave and lead 9", "nothing of it", "intent", "intent"),
    ("The tour was cancelled", "no tour took place", "leadership", "ok"),
]

# text | label, start, end (null: still running), line of each span, in order
SPANS = [
    ("{name}\nCorner Bakery\nJanuary 2010 - March 2014", [("{name} — Corner Bakery", 2010, 2014, 2)]),
    ("{name}\n2010 – Present", [("{name}", 2010, None, 1)]),
    ("Baker\n3/2010 to 12.2014", [("Baker", 2010, 2014, 1)]),
    ("Baker\n1/2/2010 until 3/4/2012", [("Baker", 2010, 2012, 1)]),
    ("Baker\n'98 - '04", [("Baker", 1998, 2004, 1)]),
    ("{name}\nSince May 2015", [("{name}", 2015, None, 1)]),
    ("Miller, Old Mill, 2001 - 2003", [("Miller, Old Mill", 2001, 2003, 0)]),
    ("In 2010 we moved and by 2014 - so it goes - we left.", []),
    ("2010 - 2014", []),
    ("Experience\n2010 - 2014", []),
    ("This is a sentence.\n2010 - 2014", []),
    ("Baker\n\n\n2010 - 2012\nCook\n2008 - 2009", [("Cook", 2008, 2009, 5), ("Baker", 2010, 2012, 3)]),
    ("Cook\n2010 - now\nBaker\n2010 - 2011", [("Baker", 2010, 2011, 3), ("Cook", 2010, None, 1)]),
    ("2019-2023  Baker, Corner Bakery", []),
    ("One\nTwo\nThree\n2001 - 2002", [("Two — Three", 2001, 2002, 3)]),
    ("Far above" + "\n" * 40 + "2001 - 2002", [("Far above", 2001, 2002, 40)]),
]

# line | with four-digit years
YEARS = [("'98 - '04", "1998 - 2004"), ("'40 and '41", "2040 and 1941"), ("it's '7", "it's '7"), ("'123", "'123"), ("May '15", "May 2015")]

# two words | the same word?
WORDS = [
    ("teaching", "teacher", True), ("teach", "teachers", True), ("engineering", "engine", True), ("baker", "baking", True),
    ("cook", "book", False), ("used", "uses", False), ("migrate", "migrating", True), ("migration", "migrating", False),
]

RECORD = "Baker\nCorner Bakery\n2005 - 2010\nFirst up at four every day\nTeacher\nNorth School\n2010 - Present\nWrote the maths course"

# claim | spans of RECORD that it names; does the record confirm, contradict the move?
MOVES = [
    ("Moved from baking to teaching", 2, True, False),
    ("Moved from teaching into the bakery", 2, False, True),
    ("Moved from teaching to sailing", 1, False, False),
    ("Bakes and teaches", 2, False, False),
    ("A school, then another school", 1, False, False),
    ("", 0, False, False),
    (None, 0, False, False),
]

# quote | the role that it stands under in RECORD, is its departure proved?
DEPARTURES = [
    ("First up at four every day", "Baker — Corner Bakery", True),
    ("Wrote the maths course", "Teacher — North School", False),
    ("I baked bread", None, True),
    ("something else", None, False),
    ("", None, False),
    (None, None, False),
]

# text | reason and evidence of two people
PEOPLE = [
    ("linkedin.com/in/ada-x and LINKEDIN.com/in/bo_y a@b.org c@d.org", "handles", "linkedin.com/in/ada-x|linkedin.com/in/bo_y"),
    ("linkedin.com/in/ada-x linkedin.com/in/ADA-x", None, ""),
    ("Mail a@b.org or C@d.org", "emails", "a@b.org|c@d.org"),
    ("a@b.org A@B.org", None, ""),
    ("Experience\nx\nEducation:\ny\nexperience\nz\neducation", "sections", "education|experience"),
    ("Experience\nx\nexperience\ny", None, ""),
    (None, None, ""),
]

EXPORT = """Contact
ada@example.org
+46 (0)70-123 45 67
12-34-56-78
Top Skills
Baking
Teaching others

Summary
She bakes &amp; teaches and writes about both each day.
Page 1 of 2
Experience
{name}
January 2010 - March 2014
2010 - 2014
www.example.org/ada
500+ connections
see example.org for more
Recommendations
Ada is great.

She really is.
Education
North School
"""

# text of an export | text without its furniture, the removed lines
EXPORTS = [
    (
        EXPORT,
        "12-34-56-78\n\nSummary\nShe bakes & teaches and writes about both each day.\nExperience\n{name}\nJanuary 2010 - March 2014\n2010 - 2014\n"
        "see example.org for more\nEducation\nNorth School",
        "Contact|ada@example.org|+46 (0)70-123 45 67|Top Skills|Baking|Teaching others|Page 1 of 2|www.example.org/ada|500+ connections|"
        "Recommendations|Ada is great.|She really is.",
    ),
    ("{name}\n\nEndorsements\nKnots\nThis line has eight words and so is prose\nmore", "{name}\n\nThis line has eight words and so is prose\nmore", "Endorsements|Knots"),
    ("", "", ""),
    (None, "", ""),
]

# text, cited quote | kind without and with the quote exempt, what quarantine leaves
GUARDED = [
    ("Hi Ada, a note", None, "salutation", "salutation", "(held back)"),
    ("first line\n  dear all", None, "salutation", "salutation", "(held back)"),
    ("with\nBest,\nM", None, "sign-off", "sign-off", "(held back)"),
    ("Kind regards", None, "sign-off", "sign-off", "(held back)"),
    ("It rests on: I'd love to chat.", "I'd love to chat", "second-person pitch", None, "(held back)"),
    ("Would you be open to it?", "Would you", "second-person pitch", None, "(held back)"),
    ("I'm reaching out since", "", "outreach opener", "outreach opener", "(held back)"),
    ("I came across your work", "elsewhere", "outreach opener", "outreach opener", "(held back)"),
    ("Ask {name} about the move; say what the role lacks.", None, None, None, "Ask {name} about the move; say what the role lacks."),
    ("The best, by far", None, None, None, "The best, by far"),
    (None, None, None, None, None),
]

# a recorded response | failure, its field x as text, as strings, as a verdict
READ = [
    ('So: {"x": "a "} and more }', None, "a ", "a ", None),
    ('<think>{"x": 1}</think>{"x": [1, "b", "c"]}', None, '[1,"b","c"]', "b|c", None),
    ('{"x": 0}', None, "", "", None),
    ('{"x": true}', None, "true", "", True),
    ('{"x": false}', None, "", "", False),
    ('{"x": " YES"}', None, " YES", " YES", True),
    ('{"x": "n/a"}', None, "n/a", "n/a", None),
    ('{"x": "no"}', None, "no", "no", False),
    ('{"x": null}', None, "", "", None),
    ('{"x": {}}', None, "", "", None),
    ('{"y": "}{", "x": "in {braces}"} tail', None, "in {braces}", "in {braces}", None),
    ('{"x": "a \\"quoted\\" } brace"}', None, 'a "quoted" } brace', 'a "quoted" } brace', None),
    ("no object here", "no_object", "", "", None),
    ('{"x": "y"', "unterminated", "", "", None),
    ('{"x": "y}', "unterminated", "", "", None),
    ("{x}", "malformed", "", "", None),
]

PROFILE = (
    "{name}\nExperience\nBaker\nCorner Bakery\n2005 - 2010\nFirst up at four every day for the sourdough line\n"
    "Teacher\nNorth School\n2010 - Present\nWrote the maths course that three schools use today\n"
    "Ran the summer camp for forty children by the lake\nKept the ovens of two bakeries going all night long"
)
MATHS = "Wrote the maths course that three schools use today"
CAMP = "Ran the summer camp for forty children by the lake"
OVENS = "Kept the ovens of two bakeries going all night long"
DAWN = "First up at four every day for the sourdough line"


def _beat(description, evidence, confidence):
    return {"description": description, "evidence": evidence, "confidence": confidence}


MIXED = {
    "throughline": "Makes things others use",
    "throughline_evidence": [MATHS, 5, "invented words here"],
    "unresolved_tension": "",
    "tension_evidence": "",
    "departures": [_beat("Left baking", DAWN, 0.95), _beat("Moved from teaching to baking", MATHS, 0.9), "not an object", _beat("", MATHS, 0.5)],
    "pursuits": [
        _beat("Writes courses", MATHS, "0.7"),
        _beat("Manages a school", MATHS, None),
        _beat("Sails", "sails the seven seas each and every year", 1),
        _beat("Bakes", "day", 1),
        _beat("Writes", "Wrote the maths course that four colleges once used", 1),
    ],
    "confidence": 1.0,
}
FIRM = {
    "throughline": "Feeds and teaches",
    "throughline_evidence": "“" + CAMP + "”",
    "unresolved_tension": "School or oven?",
    "tension_evidence": [OVENS, OVENS],
    "departures": [_beat("Left the early shifts", DAWN, 1)],
    "pursuits": [_beat("Writes courses", MATHS, 1), _beat("Runs camps", CAMP, 1), _beat("Keeps ovens", "short one", 1), _beat("Keeps ovens hot", OVENS, 2)],
}
RESPONSES = ["So: " + json.dumps(MIXED), json.dumps(FIRM), '{"throughline": "x"}', '{"throughline": " "}', "none"]

# place in RESPONSES | kind, pos, description, confidence of each kept claim
KEPT = [
    (0, "departures", 0, "Left baking", 0.9),
    (0, "pursuits", 0, "Writes courses", 0.7),
    (1, "departures", 0, "Left the early shifts", 0.9),
    (1, "pursuits", 0, "Writes courses", 0.9),
    (1, "pursuits", 1, "Runs camps", 0.9),
    (1, "pursuits", 3, "Keeps ovens hot", 0.9),
]
# place in RESPONSES | kind, pos, reason, rule and overlap of each dropped claim
DROPPED = [
    (0, "departures", 1, "contradicts_dates", "departure", 1.0),
    (0, "departures", 2, "near_miss", None, 0.671),
    (0, "pursuits", 1, "unsupported", "leadership", 1.0),
    (0, "pursuits", 2, "fabricated", None, 0.25),
    (0, "pursuits", 3, "too_short", None, 1.0),
    (0, "pursuits", 4, "near_miss", None, 0.487),
    (1, "pursuits", 2, "too_short", None, 1.0),
]
# place in RESPONSES | headline quotes, tension quotes, claims proposed and kept, drop rate, confidence
ARCS = [
    (0, MATHS, "", 9 - 1, 2, 0.75, 0.1),
    (1, CAMP, OVENS, 5, 4, 0.2, 0.72),
    (2, "", "", 0, 0, 0.0, 0.0),
]
# place in RESPONSES | why nothing could be read
FAILURES = [(3, "no_throughline"), (4, "no_object")]

ROLE = "Sourdough baker wanted, with an eye for the maths of it"
# recorded fit responses, by place in RESPONSES
FITS = [
    json.dumps({"continues_arc": True, "reasoning": "Hi Ada, come to us", "risk_flags": ["Let me know if you agree", " long commute ", ""]}),
    json.dumps({"continues_arc": "no", "reasoning": "The role leaves the school behind", "risk_flags": []}),
    json.dumps({"continues_arc": "unclear", "reasoning": "Too little to say"}),
    json.dumps({"continues_arc": True, "reasoning": "never read"}),
    json.dumps({"continues_arc": True, "reasoning": "never read"}),
]
# place in RESPONSES | verdict, was one withheld, number of flags, shared terms
VERDICTS = [(0, None, True, 3, "baker maths sourdough"), (1, False, False, 0, "baker maths sourdough"), (2, None, False, 0, "baker maths sourdough")]

# status and body of a landed completion | failure, content
COMPLETIONS = [
    (500, "x", "http", None),
    (200, "x", "unreadable", None),
    (200, '{"choices": [{"message": {"content": "<think>a</think> ", "reasoning_content": "b"}}]}', "reasoning_only", ""),
    (200, '{"choices": [{"message": {"content": null}}]}', "empty", None),
    (200, '{"choices": [{"message": {"content": "<think>a</think> b {name}"}}]}', None, "b {name}"),
]

# first bytes of a file | a PDF?
HEADS = [("%PDF-1.7", True), ("\r\n %PDF", True), ("text %PDF", False), ("", False), (None, False), (" " * 1022 + "%PDF", False)]

# requested sources | position, token, kind, login of each
REQUESTS = [
    (
        "ada-x, https://github.com/Bo/\nhttps://example.org/p ,, two words",
        [(0, "ada-x", "account", "ada-x"), (1, "https://github.com/Bo/", "account", "Bo"), (2, "https://example.org/p", "url", None), (3, "two words", "url", None)],
    ),
    ("github.com/cy", [(0, "github.com/cy", "account", "cy")]),
    (" , \n", []),
]
