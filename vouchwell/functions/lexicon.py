"""Word lists of the claim gate and of the other rules.

All are fixed values: a result depends on each entry. Entries are matched as substrings of the
lower-case text with one space added at both ends, unless whole words are asked for.
"""

from __future__ import annotations

INTENT = (
    "seeking", "seeks", "seek ", "wants to", "want to", "looking for", "looking to", "hopes to", "hoping to", "aims to",
    "aiming to", "aspires", "is pursuing", "pursuing a", "intends to", "would like to", "ready to", "eager to", "open to",
)
DEPARTURE = (
    "left", "leaving", "departed", "moved away", "moved on", "stepped away", "stepped back", "exited", "quit",
    "walked away", "gave up", "abandoned", "moved from", "transitioned from", "shifted from", "away from",
)
LEADERSHIP = (
    "lead", "leads", "leading", "led", "manage", "manages", "managing", "managed", "head of", "heads", "director",
    "supervis", "mentor", "built a team", "hired", "reports",
)
CONSEQUENCE = (
    "because", "due to", "as a result", "resulted in", "led to", "caused", "prompted", "impact", "affect", "lingering",
    "legacy of", "in the wake of", "shaped by", "frustrated", "burned out", "burnt out", "demorali", "disillusioned",
    "tired of", "weary", "resent", "bitter", "scarred", "soured", "jaded",
)

#: The gate's modes in the order they are tested.
MODES = (("intent", INTENT), ("departure", DEPARTURE), ("leadership", LEADERSHIP), ("consequence", CONSEQUENCE))

#: Headings that stand once in a profile.
PROFILE_SECTIONS = (
    "contact", "top skills", "skills", "experience", "education", "summary", "about", "certifications", "licenses",
    "honors", "publications",
)
#: Sections that are dropped: of short items, and of other people's prose.
LIST_SECTIONS = ("top skills", "skills & endorsements", "endorsements")
PROSE_SECTIONS = ("recommendations", "received recommendations", "given recommendations")
#: All headings that begin a section.
HEADINGS = LIST_SECTIONS + PROSE_SECTIONS + (
    "contact", "summary", "about", "experience", "education", "languages", "certifications", "licenses & certifications",
    "honors-awards", "honors & awards", "publications", "projects", "volunteer experience", "interests", "courses",
    "patents", "organizations", "test scores",
)
#: Headings that are never the name of a role.
NOT_A_LABEL = (
    "experience", "education", "certifications", "licenses", "summary", "about", "contact", "top skills", "skills",
    "honors", "publications", "recommendations", "volunteering", "projects", "languages",
)
#: Words of role names that identify nothing.
WEAK_WORDS = (
    "senior", "staff", "principal", "lead", "head", "chief", "director", "manager", "assistant", "associate",
    "consultant", "coordinator", "specialist", "executive", "officer", "partner", "founder", "vp", "inc", "llc", "ltd",
    "the", "and", "for", "via", "at", "of", "to", "from", "into", "moved", "left", "toward", "towards", "work",
    "working", "role", "roles", "career", "job", "jobs", "then", "now", "later",
)
#: Endings that two forms of one word may differ in.
SUFFIXES = (
    "ational", "ization", "isation", "ators", "ation", "ition", "ement", "ments", "ment", "ering", "ings", "ator",
    "ing", "ors", "ers", "ies", "ion", "ist", "or", "er", "ed", "es", "s",
)
#: Words that say nothing about skills.
STOPWORDS = (
    "and", "the", "for", "with", "you", "our", "are", "was", "were", "has", "have", "had", "not", "but", "this", "that",
    "they", "them", "their", "who", "what", "when", "will", "would", "can", "could", "should", "from", "into", "out",
    "end", "own", "all", "any", "new", "role", "work", "working", "team", "teams", "years", "year", "job", "about",
    "than", "then", "there", "here", "your", "his", "her", "its", "been", "being", "some", "more", "most", "such",
    "each", "other", "also", "how", "why",
)
#: Answers that mean that there is no verdict.
AMBIGUOUS = ("ambiguous", "unclear", "unknown", "none", "null", "n/a")
