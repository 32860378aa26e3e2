"""Values that the SQL holds of its own, in DuckDB's dialect of patterns: a wrong value in the library
doesn't pass because the SQL reads the same one."""

from __future__ import annotations

SPACE_CLASS = r"\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _spaced(pattern: str) -> str:
    """White space is written ␣, and ␢ within a class."""
    return pattern.replace("␣", f"[{SPACE_CLASS}]").replace("␢", SPACE_CLASS)


HEADINGS = (
    "top skills | skills & endorsements | endorsements | recommendations | received recommendations | given recommendations | contact | summary | "
    "about | experience | education | languages | certifications | licenses & certifications | honors-awards | honors & awards | publications | "
    "projects | volunteer experience | interests | courses | patents | organizations | test scores"
).split(" | ")
LIST_SECTIONS = (
    "top skills | skills & endorsements | endorsements"
).split(" | ")
PROSE_SECTIONS = (
    "recommendations | received recommendations | given recommendations"
).split(" | ")
WEAK_WORDS = (
    "senior staff principal lead head chief director manager assistant associate consultant coordinator specialist executive officer partner "
    "founder vp inc llc ltd the and for via at of to from into moved left toward towards work working role roles career job jobs then now later"
).split()
SUFFIXES = (
    "ational ization isation ators ation ition ement ments ment ering ings ator ing ors ers ies ion ist or er ed es s"
).split()
STOPWORDS = (
    "and the for with you our are was were has have had not but this that they them their who what when will would can could should from into out "
    "end own all any new role work working team teams years year job about than then there here your his her its been being some more most such "
    "each other also how why"
).split()
FURNITURE = tuple(
    map(
        _spaced,
        (
            r"(?i)^␣*page␣+[0-9]+␣+of␣+[0-9]+␣*$",
            r"^␣*[0-9]{1,3}␣*$",
            r"^␣*[\pL\pN_.+-]+@[\pL\pN_-]+\.[\pL\pN_.]+␣*$",
        ),
    )
)
FURNITURE_AFTER_PHONE = tuple(
    map(
        _spaced,
        (
            r"(?i)^␣*(www\.|https?://)[^␢]+",
            r"(?i)^␣*[0-9][0-9,+]*␣+(connections|followers)␣*$",
            r"(?i)^␣*contact␣*$",
            r"(?i)^␣*\(linkedin\)␣*$",
            r"^␣*[\pL\pN_.+-]+@[\pL\pN_-]+␣*$",
            r"(?i)^␣*\.[a-z]{2,6}␣*$",
            r"(?i)^␣*[^␢]+\.[a-z]{2,6}␣*\((other|personal|company|portfolio)\)␣*$",
        ),
    )
)
PHONE = _spaced(r"^␣*\+?[0-9][0-9␢().-]{7,}$")
PHONE_DIGITS = 9
DATE_LINE = _spaced(r"(?i)^␣*([\pL\pN_]+␣+)?[0-9]{4}␣*[-–—to]+␣*(([\pL\pN_]+␣+)?[0-9]{4}|present|current)␣*$")
PROSE_WORDS = 8
MESSAGES = (
    (r"(?i)\b(hi|hey|hello|dear)\b[ ,]+[A-Z][a-z]+", "salutation"),
    (r"(?im)^[ \t\r\x0b\f]*(hi|hey|hello|dear)\b", "salutation"),
    (r"(?i)\b(best|regards|cheers|thanks|sincerely|warmly)\s*,\s*\n", "sign-off"),
    (r"(?i)\b(best|kind) regards\b", "sign-off"),
    (r"(?i)\bi(?:'d| would) love to (chat|talk|connect|hear)\b", "second-person pitch"),
    (r"(?i)\bwould you be (open|interested|available)\b", "second-person pitch"),
    (r"(?i)\bi(?:'m| am)?\s+reaching out\b", "outreach opener"),
    (r"(?i)\bcame across your (profile|background|work)\b", "outreach opener"),
    (r"(?i)\b(are|were) you (open|interested|looking)\b", "second-person pitch"),
    (r"(?i)\blet me know if you\b", "second-person pitch"),
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TERM = r"[a-z][a-z+#.]{2,}"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
TRIMMED_MARKS = ' \t\r\n"\'“”‘’.,;:-—–'
MIN_SPAN_CHARS = 12
MIN_STEM = 3
TURN_MODES = (("alpha", ("thing", "edth")), ("beta", ("ation", "lich")), ("gamma", ("eaux", "ción")))
