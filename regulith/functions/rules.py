"""Catalogs of the rules: what counts as a burden, jargon, a section marker and so on.

All patterns ignore case unless it is said otherwise, and are written in the syntax
that Java and RE2 share; ``rx`` adds the flags.
"""

from __future__ import annotations

# Everything below has to be as it is for right results.

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")  # ranks 1 to 4

#: Types of burden in their order, which matters where free text is mapped to a type.
BURDEN_TYPES = (
    "wet_signature",
    "notarization",
    "certified_copy",
    "original_document",
    "mandatory_report",
    "periodic_filing",
    "duplicate_reporting",
    "in_person_appearance",
    "mandatory_meeting",
    "public_hearing",
    "multi_agency_approval",
    "sequential_approval",
    "redundant_approval",
    "waiting_period",
    "expiration_requirement",
    "renewal_requirement",
    "excessive_documentation",
    "redundant_information",
    "outdated_form",
    "excessive_fee",
    "multiple_fees",
    "non_refundable_fee",
    "conflicting_requirement",
    "duplicative_statute",
    "outdated_reference",
    "vague_standard",
    "no_digital_option",
    "paper_only",
    "mail_only",
)

#: Type → category; every other type is administrative.
CATEGORY = {
    "mandatory_report": "compliance",
    "periodic_filing": "compliance",
    "duplicate_reporting": "compliance",
    "multi_agency_approval": "compliance",
    "waiting_period": "opportunity",
    "in_person_appearance": "opportunity",
    "mandatory_meeting": "opportunity",
    "vague_standard": "learning",
    "conflicting_requirement": "learning",
    "excessive_fee": "psychological",
    "non_refundable_fee": "psychological",
}
DEFAULT_CATEGORY = "administrative"

#: Type → typical severity; every other type is MEDIUM.
TYPICAL_SEVERITY = {
    "wet_signature": "MEDIUM",
    "notarization": "HIGH",
    "in_person_appearance": "HIGH",
    "mandatory_report": "MEDIUM",
    "waiting_period": "MEDIUM",
    "multi_agency_approval": "HIGH",
    "conflicting_requirement": "CRITICAL",
    "excessive_fee": "MEDIUM",
    "paper_only": "MEDIUM",
    "vague_standard": "LOW",
}
DEFAULT_SEVERITY = "MEDIUM"

#: Words in an excerpt → ranks by which they raise a severity; the largest counts.
ESCALATION = {"mandatory": 1, "penalty": 1, "violation": 1, "felony": 2, "void": 1, "invalid": 1}

#: Names of statutory rule groups whose type has another name.
GROUP_TYPE = {"in_person": "in_person_appearance", "publication": "mandatory_report", "hearing": "public_hearing", "approval_chain": "multi_agency_approval", "paper_requirement": "paper_only", "conflicting": "conflicting_requirement"}

#: Statutory rules: group → patterns.
STATUTORY = {
    "wet_signature": (
        r"shall (?:be )?sign(?:ed)? (?:by|in)",
        r"signature (?:of|by) the",
        r"personally sign",
        r"original signature",
    ),
    "notarization": (
        r"shall be notarized",
        r"acknowledged before a notary",
        r"notary public",
        r"notarial (?:seal|certificate)",
    ),
    "in_person": (
        r"shall appear (?:in person|before)",
        r"personal appearance",
        r"physically present",
        r"appear at (?:a|the) (?:office|hearing|meeting)",
    ),
    "mandatory_report": (
        r"shall (?:submit|file|provide) (?:a |an )?(?:annual|quarterly|monthly)? ?report",
        r"report(?:ing)? requirement",
        r"shall report to (?:the )?(?:department|agency|board)",
    ),
    "waiting_period": (
        r"(?:at least |not less than |no fewer than )\d+ (?:day|week|month)",
        r"waiting period of \d+",
        r"\d+ day(?:s)? (?:prior to|before|after)",
        r"cooling[- ]off period",
    ),
    "publication": (
        r"shall (?:be )?publish(?:ed)? (?:in|for)",
        r"notice shall be published",
        r"publication in (?:a |the )?newspaper",
    ),
    "hearing": (
        r"public hearing shall be held",
        r"opportunity for (?:a )?hearing",
        r"hearing before (?:the|a)",
    ),
    "approval_chain": (
        r"approval (?:of|from|by) (?:the )?(?:director|commissioner|secretary|board|department)",
        r"with the consent of",
        r"subject to (?:the )?approval",
    ),
    "excessive_fee": (
        r"fee (?:of|not (?:to )?exceed(?:ing)?) \$?\d+",
        r"filing fee",
        r"application fee",
        r"license fee of",
    ),
    "paper_requirement": (
        r"in writing",
        r"written (?:notice|application|request|consent)",
        r"by (?:certified|registered) mail",
        r"delivered by mail",
    ),
    "outdated_reference": (
        r"as (?:it )?existed on (?:January|February|March|April|May|June|July|August|September|October|November|December) \d+, (?:19|20)\d{2}",
        r"prior to (?:January|February|March|April|May|June|July|August|September|October|November|December) \d+, (?:19|20)\d{2}",
    ),
    "conflicting": (
        r"notwithstanding (?:any )?(?:other )?(?:provision|section|law)",
        r"except as (?:otherwise )?provided",
        r"in the event of (?:a )?conflict",
    ),
}

#: Taxonomy rules: type → patterns.
TAXONOMY = {
    "wet_signature": (
        r"original signature",
        r"signed in ink",
        r"hand-?signed",
        r"wet signature",
        r"physical signature",
    ),
    "notarization": (
        r"notari[zs]ed",
        r"notary public",
        r"acknowledged before",
        r"sworn before",
    ),
    "in_person_appearance": (
        r"appear in person",
        r"personal appearance",
        r"physically present",
        r"appear before",
        r"in-?person",
    ),
    "mandatory_report": (
        r"shall (submit|file|provide) a report",
        r"required to report",
        r"annual report",
        r"quarterly report",
        r"monthly report",
    ),
    "waiting_period": (
        r"\d+\s*days? (before|after|prior|following)",
        r"waiting period",
        r"cooling[- ]off period",
        r"not (less|fewer) than \d+",
    ),
    "multi_agency_approval": (
        r"approval (of|from|by) .+ (and|,) .+ (department|agency|board)",
        r"coordinate with",
        r"consultation with .+ (agency|department)",
    ),
    "conflicting_requirement": (
        r"notwithstanding .+ (section|provision)",
        r"except as provided",
        r"in conflict with",
    ),
    "excessive_fee": (
        r"fee of \$?\d+",
        r"filing fee",
        r"application fee",
        r"processing fee",
    ),
    "paper_only": (
        r"in writing",
        r"written (notice|application|request)",
        r"mail(ed)? to",
        r"by (certified|registered) mail",
    ),
    "vague_standard": (
        r"as (the|an?) .+ (deems|determines) (appropriate|necessary)",
        r"reasonable",
        r"adequate",
        r"sufficient",
        r"good cause",
    ),
}

#: Jargon → plain words, applied one after another; "" removes.
JARGON = {
    "herein": "in this document",
    "hereof": "of this document",
    "hereby": "",
    "hereto": "to this",
    "hereafter": "after this",
    "heretofore": "before this",
    "thereof": "of that",
    "therein": "in that",
    "thereto": "to that",
    "whereof": "of which",
    "wherein": "in which",
    "whereas": "",
    "aforementioned": "mentioned above",
    "aforesaid": "mentioned above",
    "notwithstanding": "despite",
    "pursuant to": "under",
    "in accordance with": "following",
    "with respect to": "about",
    "in the event that": "if",
    "for the purpose of": "to",
    "in order to": "to",
    "prior to": "before",
    "subsequent to": "after",
    "at such time as": "when",
    "in the amount of": "for",
    "by means of": "by",
    "by virtue of": "by",
    "due to the fact that": "because",
    "in lieu of": "instead of",
    "with regard to": "about",
    "it is necessary that": "must",
    "is authorized to": "may",
    "is required to": "must",
    "is entitled to": "may",
    "shall be": "is",
    "shall not": "must not",
    "shall have": "has",
}

#: Pattern → weight in a provision's burden score.
SCORE_START, SCORE_LOW, SCORE_HIGH = 5.0, 1.0, 10.0
SCORE_WEIGHTS = {
    r"\b(shall|must|required)\b": 0.1,
    r"\bnotari": 0.5,
    r"\bin person\b": 0.5,
    r"\bwithin \d+ days\b": 0.2,
    r"\bfee\b": 0.2,
    r"\bpublic hearing\b": 0.3,
    r"\bwritten (notice|consent)\b": 0.2,
    r"\bonline\b": -0.3,
    r"\belectronic(ally)?\b": -0.3,
    r"\bmay\b": -0.1,
    r"\bwaiv(e|er)\b": -0.2,
}

#: Section markers; group 1 is the id.
SECTION_MARKERS = (
    r"(?:Section|Sec\.|§)\s*(\d+[\w.-]*)",
    r"(?:Article)\s+([IVXLCDM]+|\d+)",
    r"(?:Chapter|Ch\.)\s+(\d+[\w.-]*)",
    r"(?:Part)\s+([A-Z]|\d+)",
)
CROSS_REFERENCE = r"(?:pursuant to|under|as defined in|see|refer to)\s+(?:section|§)\s*([\d.]+(?:\([a-z]\))?)"
DEFINITION = r'"([^"]+)"\s+means\s+([^.]+\.)'
CITATION = r"(?:(\d+)\s+)?(?:U\.?S\.?C\.?|C\.?F\.?R\.?|Stat\.?)\s*(?:§|Section)?\s*([\d.]+)(?:\s*\(([a-z0-9]+)\))?"  # with case

#: Of a section's complexity. The first and the last heed case.
NESTED_CLAUSE = r"\([a-z]\)"
COMPLEX_JARGON = r"\b(herein|thereof|whereby|notwithstanding|pursuant|aforementioned)\b"
COMPLEX_PASSIVE = r"\b(shall be|is|are|was|were)\s+\w+ed\b"

PASSIVE = (
    r"\b(is|are|was|were|be|been|being)\s+(\w+ed)\b",
    r"\b(is|are|was|were)\s+to\s+be\s+(\w+ed)\b",
)

SENTENCE_END = r"[.!?]+"
FEE = r"\$\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"
TIMEFRAME = r"(\d+)\s*(day|week|month|year)s?"
DIGITAL = r"\b(online|electronic|digital)\b"

#: Document type → phrases of lower-cased text, in order of precedence.
DOCUMENT_TYPES = {
    "administrative_code": ("administrative code", "admin. code"),
    "regulation": ("c.f.r.", "code of federal regulations"),
    "statute": ("u.s.c.", "united states code"),
    "executive_order": ("executive order",),
    "bill": ("bill", "be it enacted"),
    "policy": ("policy", "guidance"),
}

#: Lowest Flesch score of each rating.
RATINGS = {"Accessible": 70, "Moderate": 50, "Complex": 30}
LOWEST_RATING = "Very Complex"

#: Type → recommendation with the number of findings; other types have the last one, with their name.
RECOMMENDATIONS = {
    "wet_signature": "Enable e-signatures: Found %d wet signature requirements. Adopt UETA/E-SIGN compliant electronic signature standards.",
    "notarization": "Allow remote notarization: Found %d notarization requirements. Adopt remote online notarization (RON) to reduce in-person burden.",
    "in_person_appearance": "Enable virtual options: Found %d in-person requirements. Allow video conferencing alternatives where feasible.",
    "waiting_period": "Review waiting periods: Found %d mandatory delays. Assess whether each waiting period serves a legitimate purpose.",
    "paper_only": "Digitize paper processes: Found %d paper-only requirements. Enable online submission and digital document acceptance.",
}
OTHER_RECOMMENDATION = "Review %s: Found %d instances. Assess necessity and potential for streamlining."

#: Words in a free-text type → type, where no name fits.
TYPE_WORDS = {"signature": "wet_signature", "notar": "notarization", "person": "in_person_appearance", "appear": "in_person_appearance", "wait": "waiting_period", "period": "waiting_period", "fee": "excessive_fee", "report": "mandatory_report"}
DEFAULT_TYPE = "excessive_documentation"

READABILITY_LEVELS = ("general_public", "business", "technical", "legal")
STAGES = ("created", "scanned", "analyzed", "drafted", "reviewed", "introduced", "enacted")
