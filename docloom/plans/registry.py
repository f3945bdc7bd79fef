"""The rules of the document review, and the cues over typed text.

Ids, families and relevances are fixed; patterns are made from plain lists of words.
"""

from __future__ import annotations

from docloom.operators.compare import MONTHS, NUMBERS, ROLES
from docloom.operators.rules import Hinted, Rule


def _phrases(phrases: tuple[str, ...], end: str) -> Hinted:
    said = "|".join(p.replace(" ", chr(92) + "s+") for p in phrases)
    return Hinted(rf"\b(?:{said}){end}", *(max(p.split(), key=len) for p in phrases))


def words(*phrases: str) -> Hinted:
    """A pattern of whole words: one of the phrases."""
    return _phrases(phrases, r"\b")


def begins(*beginnings: str) -> Hinted:
    """A pattern of words that begin so."""
    return _phrases(beginnings, "")


def near(first: Hinted, second: str, most: int = 60) -> Hinted:
    """A pattern of one thing and another within so many characters behind it."""
    return Hinted(f"{first}.{{0,{most}}}?{second}", *first.hints)


SUM = r"(?:rs[.]?|inr|rupees|₹)\s*\d(?:[\d,]*\d)?(?:[.]\d+)?(?:\s*/-)?"
_NUMBER = "|".join(sorted(NUMBERS, key=lambda w: (-len(w), w)))
SPAN = rf"(?:\d+|(?:{_NUMBER}))(?:\s*[(]\s*\w+\s*[)])?\s*(?:hour|day|week|month|year)s?"
OFFER, RENTAL = ("offer_letter",), ("rental",)

#: How relevant each rule is before signing, when a problem has started, and when versions are compared.
RELEVANCE = {
    "money.payment-terms": ("primary", "secondary", "primary"),
    "money.deposit": ("primary", "primary", "secondary"),
    "money.late-fees": ("primary", "primary", "secondary"),
    "money.bond-repayment": ("primary", "primary", "secondary"),
    "money.discretionary": ("primary", "secondary", "secondary"),
    "money.who-pays": ("secondary", "secondary", "secondary"),
    "time.term": ("primary", "secondary", "primary"),
    "time.deadline": ("secondary", "primary", "secondary"),
    "time.renewal": ("primary", "secondary", "primary"),
    "time.probation": ("primary", "secondary", "background"),
    "time.survival": ("primary", "secondary", "secondary"),
    "time.dated": ("background", "primary", "background"),
    "duty.non-compete": ("primary", "secondary", "secondary"),
    "duty.non-solicit": ("primary", "secondary", "secondary"),
    "duty.restrictions": ("secondary", "secondary", "secondary"),
    "duty.one-sided": ("primary", "secondary", "primary"),
    "duty.upkeep": ("secondary", "primary", "background"),
    "duty.hours": ("primary", "secondary", "secondary"),
    "duty.one-way": ("primary", "secondary", "secondary"),
    "duty.conditions": ("primary", "secondary", "background"),
    "exit.notice": ("primary", "primary", "primary"),
    "exit.notice-service": ("secondary", "primary", "background"),
    "exit.termination": ("primary", "primary", "primary"),
    "exit.lock-in": ("primary", "primary", "secondary"),
    "exit.handover": ("secondary", "primary", "background"),
    "exit.remedies": ("primary", "primary", "primary"),
    "exit.liability": ("primary", "primary", "primary"),
    "exit.disputes": ("secondary", "primary", "secondary"),
    "data-ip.confidentiality": ("primary", "secondary", "secondary"),
    "data-ip.ip": ("primary", "secondary", "secondary"),
    "data-ip.personal-data": ("primary", "secondary", "primary"),
    "data-ip.monitoring": ("primary", "secondary", "secondary"),
    "data-ip.incident": ("secondary", "primary", "background"),
    "data-ip.handling": ("primary", "secondary", "background"),
}


def _rule(id: str, title: str, any: list[str], **more) -> Rule:
    return Rule(id, title, any, ranks=RELEVANCE[id], **more)


RULES = (
    _rule("money.payment-terms", "Amounts payable", [Hinted(rf"(?<amount>{SUM})", "rs", "inr", "rupees", "₹")], all=[begins("pay", "rent", "fee", "charge", "salar", "month", "per month")], none=[words("deposit", "damages", "repay"), begins("late pa", "late-pa")], prompt="Check {clause}: is {amount|the amount} the sum you expect, and when is it due?", category="payment"),
    _rule("money.deposit", "Deposit and refund", [words("security deposit", "refundable"), near(words("deposit"), begins("refund", "return", "deduct"))], prompt="When is the deposit of {clause} due back, and what may be kept of it?"),
    _rule("money.late-fees", "Charges for late payment", [begins("late fee", "late charge", "late payment", "late-payment", "penal interest"), words("per day of delay"), near(words("interest"), begins("delay", "overdue"), 12)], none=[begins("deduct")], category="penalty"),
    _rule("money.bond-repayment", "Bonds and repayment", [words("training bond", "training cost", "training costs", "service bond", "repay"), near(begins("reimburs"), words("company", "employer"), 12), near(begins("recover"), words("salary", "final pay", "dues"))], category="bond"),
    _rule("money.discretionary", "Pay at discretion", [begins("discretion"), words("not guaranteed", "no guarantee", "at any time")], all=[words("pay", "bonus", "commission", "incentive", "allowance", "variable")]),
    _rule("money.who-pays", "Who bears which cost", [words("borne by", "stamp duty", "maintenance charges", "own cost", "own expense"), near(words("water", "electricity", "utility", "gas"), begins("bill", "charge"), 4)], category="charges"),
    _rule("time.term", "How long it lasts", [near(words("term", "period", "tenure", "duration"), rf"(?<period>{SPAN})", 12), near(begins("commenc", "starts", "begins"), words("on", "from"), 2)], none=[words("notice", "probation")]),
    _rule("time.deadline", "Deadlines", [Hinted(rf"\b(?:within|(?:no|not) later than)\s+(?<window>{SPAN})", "within", "later"), words("on or before", "valid till", "valid until")]),
    _rule("time.renewal", "Renewal", [begins("renew", "extend", "extension"), words("automatically")], all=[words("term", "lease", "licence", "license", "contract", "agreement")], none=[begins("probation")]),
    _rule("time.probation", "Probation", [begins("probation"), words("confirmation of employment", "confirmation in service")], types=OFFER),
    _rule("time.survival", "What outlives the end", [begins("surviv"), words("indefinitely", "in perpetuity"), near(words("after"), begins("terminat", "expir", "end of"), 5)]),
    _rule("time.dated", "Dates named", [Hinted(rf"\b\d{{1,2}}(?:st|nd|rd|th)?(?:\s+day)?(?:\s+of)?\s+(?:{'|'.join(MONTHS)})\p{{L}}*[.]?,?\s+\d{{4}}\b", *MONTHS)], category="date"),
    _rule("duty.non-compete", "Competing work", [begins("non-compet", "non compet", "noncompet", "competing business", "competing work"), near(words("shall not"), words("employed by", "work for a competitor"))]),
    _rule("duty.non-solicit", "Soliciting", [begins("solicit", "non-solicit", "nonsolicit")]),
    _rule("duty.restrictions", "What may not be done", [near(words("tenant", "licensee", "employee", "recipient", "customer", "party", "parties"), words("shall not", "must not", "may not"), 2), words("prior written consent", "prior written approval", "solely for")], category="restriction"),
    _rule("duty.one-sided", "One side decides", [words("sole discretion", "from time to time", "may revise", "may vary", "may amend", "may assign")]),
    _rule("duty.upkeep", "Repairs and upkeep", [words("repair", "repairs", "wear and tear", "upkeep"), Hinted(rf"{words('maintenance')}(?!\s+charges)", "maintenance")], all=[words("responsible", "shall", "must", "will")], types=RENTAL),
    _rule("duty.hours", "Hours and leave", [words("overtime", "working hours", "sick leave", "annual leave", "casual leave", "earned leave"), near(words("hours"), words("per day", "a day", "per week", "a week"), 2)], types=OFFER),
    _rule("duty.one-way", "Duties of one side only", [begins("unilateral"), words("one-way"), near(words("no"), words("reciprocal obligation", "corresponding obligation"), 2)]),
    _rule("duty.conditions", "Conditions", [near(words("subject to", "conditional on", "conditional upon"), begins("verif", "check", "document")), words("background check", "background verification"), near(begins("submit"), words("documents"), 40)], category="condition"),
    _rule("exit.notice", "Notice to end it", [Hinted(rf"(?<period>{SPAN})\W+(?:\w+\W+){{0,3}}?notice\b", "notice"), near(words("notice"), rf"(?<period>{SPAN})", 20), words("notice period", "pay instead of notice")], all=[begins("terminat", "resign", "quit", "vacat", "leav", "expir", "end")], prompt="Check {clause}: is {period|the notice} the same for both sides?"),
    _rule("exit.notice-service", "How notice is given", [near(begins("notice"), words("in writing"), 20), words("deemed served", "deemed received", "deemed delivered", "registered post")]),
    _rule("exit.termination", "Ending at once", [begins("immediate", "insolven", "misconduct"), words("material breach", "without cause")], all=[begins("terminat")]),
    _rule("exit.lock-in", "Minimum period", [Hinted(rf"\block(?:-|\s)?in\b(?:.{{0,40}}?(?<period>{SPAN}))?", "lock"), words("minimum period", "unexpired period", "unexpired portion")]),
    _rule("exit.handover", "Handing over", [begins("hand over", "handing over"), words("vacate"), near(begins("return"), words("keys", "assets", "documents", "property"), 12)]),
    _rule("exit.remedies", "Remedies", [begins("indemnif", "forfeit"), words("liquidated damages", "injunctive relief", "penalty of")], category="remedy"),
    _rule("exit.liability", "Limits of liability", [near(words("no", "not"), begins("liab"), 5), near(words("liability"), words("limited to"), 30), near(words("indirect", "consequential"), begins("loss", "damage"), 3)]),
    _rule("exit.disputes", "Disputes", [begins("arbitrat", "mediat"), words("jurisdiction", "governing law"), near(begins("court"), words("at", "in", "of"), 2)], category="dispute"),
    _rule("data-ip.confidentiality", "Confidentiality", [begins("confidential", "trade secret", "non-disclosure")], none=[r"^whereas\b"]),
    _rule("data-ip.ip", "Ownership of work", [begins("intellectual propert", "copyright", "patent"), words("work product", "moral rights")]),
    _rule("data-ip.personal-data", "Personal data", [words("personal data", "personal information", "privacy"), begins("biometric")]),
    _rule("data-ip.monitoring", "Monitoring", [begins("monitor"), words("surveillance", "cctv", "enter and inspect")]),
    _rule("data-ip.incident", "Incidents", [words("data breach", "incident", "theft", "loss"), near(begins("unauthoris", "unauthoriz"), begins("access", "disclos"), 3)], all=[begins("notif", "report", "inform")]),
    _rule("data-ip.handling", "Handling of data", [begins("encrypt"), words("cloud", "copies", "ai tool", "ai tools")]),
)

#: Cues over what a reader types, most specific first: name, patterns, guidance. Written for plain speech, with a few Hindi forms.
_CHILDREN = "(?:son|daughter|child|children|kids?|baby|toddler|nephew|niece)"
_FAMILY = "(?:husband|wife|partner|father|mother|brother|in-laws|boyfriend|girlfriend|ex)"
_HARM = "(?:hits?|hurts?|hurting|beats?|beat|beating|slaps?|slapped|kicks?|kicked|chokes?|choked|abus(?:es|ed|ing))"
SAFETY_CUES = {
    "child": ([rf"\b(?:my|our|her|his)\s+{_CHILDREN}\b.{{0,40}}?\b(?:{_HARM}|missing|in danger|not safe|unsafe|starving)\b", rf"\b{_HARM}\s+(?:my|our|the)\s+{_CHILDREN}\b", r"बच्चे\s+को\s+मार"], ["child-helpline", "emergency"]),
    "domestic": ([rf"\bmy\s+{_FAMILY}\b.{{0,30}}?\b(?:{_HARM}|threatens?|threatened)\b.{{0,20}}?\b(?:me|us)\b", r"\bafraid\s+(?:to go home|of my " + _FAMILY + r")\b", r"\bpati\s+(?:mujhe\s+)?maar"], ["women-helpline", "emergency", "legal-aid"]),
    "violence": ([r"\b(?:hit|hurt|beat|attack)(?:s|ing|ed)? me\b", r"\bthreaten\w* to (?:hurt|kill|harm)", r"\bmujhe\s+(?:maar|peet)", r"मुझे\s+मार"], ["emergency", "police"]),
    "self-harm": ([r"\bkill myself\b", r"\bend my life\b", r"\bsuicid", r"\b(?:marna|mar jana)\s+chaht[aie]\b", r"आत्महत्या"], ["helpline"]),
    "eviction": ([r"\block(?:ed|ing)? (?:me|us) out\b", r"\bthrown? (?:me|us) out\b", r"\bghar\s+se\s+nikal"], ["legal-aid", "police"]),
    "detention": ([r"\b(?:took|taken|keep\w*|holding) my passport\b", r"\bnot (?:let|allow\w*) me (?:to )?leave\b"], ["police", "legal-aid"]),
    "coercion": ([r"\bforc\w* (?:me|us) to sign\b", r"\bsign (?:it )?or else\b"], ["legal-aid"]),
}
#: What shows that a text with a cue's words isn't one: negations, works of fiction, terms of art.
_TOLD = r"\b(?:film|movie|novel|episode|hypothetical(?:ly)?|joking|joke)\b"
SAFETY_VETOES = {
    "child": [_TOLD, r"\bchild(?:ren)?\s+(?:labour|care|support)\s+clause\b"],
    "domestic": [_TOLD, r"\b(?:never|does not|doesn't|did not|didn't)\s+(?:hit|hurt|beat|threaten)"],
    "violence": [_TOLD, r"\b(?:nobody|no one|never|did not|didn't|does not|doesn't)\s+(?:hit|hurt|beat|attack|threaten)", r"\b(?:hits|hit|hurts|hurt) me (?:in the pocket|financially|hard financially)\b"],
    "self-harm": [_TOLD, r"\bsuicide\s+(?:clause|exclusion|cover)\b"],
}
#: Texts inside a document that speak to a model instead of to its reader, by what they try.
INSTRUCTIONS = {
    "override": [r"\bignore (?:all |any )?(?:previous|prior|above) (?:instructions|prompts)\b", r"\bdisregard the (?:above|instructions)\b", r"\bforget (?:everything|all) (?:you|said|above|before)\b"],
    "role": [r"\byou are now\b", r"\bact as (?:a|an|the)\b.{0,30}\b(?:assistant|model|lawyer)\b", r"\bsystem prompt\b", r"\bpretend (?:to be|that you)\b"],
    "output": [r"\b(?:respond|reply|answer) only with\b", r"\bdo not (?:mention|reveal|tell)\b", r"\b(?:print|repeat|show) (?:your|the) (?:instructions|rules|hidden)\b"],
    "markup": [r"<[|]?/?(?:system|assistant|user|im_start|im_end)[|]?>", r"(?:^|\n)\s*(?:system|assistant)\s*:\s", r"\[/?inst\]"],
    "new-task": [r"\b(?:new|updated|real) (?:instructions|task) (?:for (?:the|an) (?:ai|model|assistant)|follow|below)\b", r"\b(?:dear|attention|note to(?: the)?) (?:ai|model|assistant|language model)\b"],
    "verdict-order": [r"\b(?:rate|mark|report|describe|summari[sz]e) this (?:document|agreement|contract|clause) as (?:safe|fair|standard|low risk|favou?rable)\b"],
    "secrets": [r"\b(?:send|post|upload|forward) (?:the |this |all |your )?(?:conversation|data|answers?|keys?) to\b", r"\bapi key\b"],
}
LANGUAGE = {
    "verdict": [r"\b(?:is|are) (?:illegal|unlawful|unenforceable|void)\b", r"\byou will (?:win|lose)\b"],
    "advice": [r"\byou (?:should|must) (?:sign|refuse|sue|pay)\b", r"\bwe (?:advise|recommend)\b"],
    "certainty": [r"\b(?:definitely|certainly|guaranteed|without doubt)\b"],
    "alarm": [r"\b(?:dangerous|outrageous|predatory|scam)\b"],
    "reassurance": [r"\b(?:perfectly safe|nothing to worry|completely fair)\b"],
}
#: How a statement puts something to the reader instead of telling them what holds: by asking, by an
#: invitation to look or to speak, by what would help, or by what the document leaves out.
_LOOKING = ("check", "compare", "look", "inspect", "measure", "read", "review", "see whether", "weigh", "work through", "add up")
_SPEAKING = ("agree", "ask", "discuss", "get it in writing", "negotiate", "query", "request", "talk to", "write to")
_LEADS = ("please", "perhaps", "maybe", "first", "next", "then", "before you sign", "do")
_INVITED = words(*_LOOKING, *_SPEAKING)
_DOCUMENTS = ("agreement", "annexure", "clause", "contract", "deed", "document", "draft", "lease", "letter", "paragraph", "wording")
_SAID = ("address", "answer", "deal with", "describe", "mention", "record", "say", "show", "specify", "spell out", "tell")
REVIEW_REGISTER = (
    "[?]",
    rf"(?:^|[.;:!]\s*|,\s*)(?:(?:{'|'.join(w.replace(' ', chr(92) + 's+') for w in _LEADS)}),?\s+)?{_INVITED}",
    rf"\b(?:you|readers|a reader|the reader|whoever signs)\s+(?:can|could|may|might)\s+(?:(?:want|wish|like|need)\s+to\s+|also\s+)*{_INVITED}",
    rf"\bworth\s+(?:a\s+|an\s+)?(?:\w+ing|look|question|second reading)\b",
    rf"\b(?:helps|useful|sensible|wise|prudent)\s+to\s+{_INVITED}",
    near(words(*_DOCUMENTS), near(words("does not", "doesn't", "do not", "fails to", "nowhere"), words(*_SAID), 3), 3),
    words("silent on", "silent about", "leaves open", "left open", "not settled", "without saying", *(f"{a} {b}" for a in ("unclear", "uncertain", "open") for b in ("whether", "who", "when", "how"))),
)
#: Party cues with their weights; the first of equal weights counts. A quoted term in brackets counts where it is a role.
TITLES = ("mr", "mrs", "ms", "mx", "dr", "prof", "sri", "shri", "smt", "kum", "capt", "col")
_ROLE = "|".join(sorted(ROLES | {"party", "firm", "society", "bank"}))
PARTY_CUES = (
    (3, near(words("hereinafter", "hereafter", "in this deed"), words("called", "known as", "referred to", "named"), 30)),
    (3, rf"\bof\s+the\s+(?:first|second|third|fourth|one|other)\s+part\b"),
    (3, rf"[(]\s*(?:the\s+)?[\"“”](?:[^\"“”()]{{0,20}}\s)?(?:{_ROLE})s?[\"“”]\s*[)]"),
    (2, near(begins("enter", "execut", "conclud", "made"), words("between"))),
    (1, rf"^(?:{'|'.join(TITLES)})[.]?\s+\p{{L}}[\p{{L}}.'’ -]*(?:,|\s+(?:of|son|daughter|wife|residing|aged)\b|\z)"),
    (1, r"^I,\s+[\p{L}.'’ -]+,"),
)
#: Headings after which a party is named.
PARTY_HEADINGS = ("between", "and", "by and between", "among", "parties")
#: Fields of the document map: categories and rules that count as evidence.
FIELDS = {
    "parties": [],
    "dates": ["time.dated", "time.term", "time.renewal", "time.deadline"],
    "money": ["money.payment-terms", "money.deposit", "money.late-fees", "money.bond-repayment", "money.discretionary", "money.who-pays"],
    "duties": ["duty.non-compete", "duty.non-solicit", "duty.restrictions", "duty.one-sided", "duty.upkeep", "duty.hours", "duty.one-way", "duty.conditions"],
    "termination": ["exit.notice", "exit.notice-service", "exit.termination", "exit.lock-in", "exit.handover"],
    "dispute": ["exit.disputes"],
}
#: In which order a stage reads the families, what it asks for, and what it gives.
STAGE_PLANS = {
    "before-signing": (("duty", "time", "exit", "money", "data-ip"), ("decision-deadline",), ("document-map", "review-prompts", "questions-to-ask")),
    "problem-started": (("exit", "time", "money", "duty", "data-ip"), ("key-dates", "evidence", "response-deadline"), ("timeline", "review-prompts", "evidence-checklist", "document-map")),
    "compare-versions": (("money", "time", "duty", "exit", "data-ip"), ("newer-version",), ("change-cards", "document-map")),
}
STOPWORDS = frozenset("an the and or but if then than so as of in on at to for from by with about into over under after before between is am are was were be been being do does did have has had will would shall should can could may might must it its this that these those my your his her our their me you he she we they what when where which who how why not no".split())
#: Words readers use, and the words documents use for them.
SYNONYMS = {
    "fired": ["termination", "dismissal"], "quit": ["resignation", "notice period"], "leave": ["vacate", "exit"], "money": ["payment", "amount"],
    "rent": ["licence fee"], "deposit": ["security deposit"], "landlord": ["licensor", "lessor"], "tenant": ["licensee", "lessee"], "boss": ["employer"],
    "salary": ["remuneration", "wages"], "fine": ["penalty", "liquidated damages"], "court": ["jurisdiction", "arbitration"], "secret": ["confidential"],
}
#: Concerns and the resources that help, in order.
ROUTING = {"housing": ["legal-aid", "rent-authority"], "work": ["labour-office", "legal-aid"], "safety": ["emergency", "police", "helpline"], "privacy": ["data-board"]}
