"""Word lists, patterns and tables that results depend on, in their natural order.

Patterns are matched without regard to case unless said otherwise; where several rules could hold, the first does.
"""

# Words that say nothing about a text in keyword search.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he",
    "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were",
    "will", "with", "this", "these", "those", "or", "not", "but", "what", "which",
    "who", "whom", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "only", "own",
    "same", "so", "than", "too", "very", "can", "could", "should", "would",
)

# Common English words, by which the language is told and which are no keywords.
ENGLISH = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from",
    "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the",
    "their", "this", "to", "was", "were", "will", "with", "you", "your",
    "not", "can", "may", "must", "shall", "should", "all", "any", "each",
    "such", "than", "then", "into", "over", "under", "about", "after",
    "before", "between", "during", "through", "via", "also", "only",
    "other", "more", "most", "some", "these", "those", "when", "where",
    "which", "who", "whom", "what", "how", "why",
)

# Suffixes that the stemmer takes off, the first that leaves more than three letters.
SUFFIXES = ("ing", "edly", "ment", "ness", "able", "ible", "ions", "ion", "ies", "es", "ed", "s")

# Letters that case folding turns into several, or into ASCII, beyond lower case.
FOLDS = {
    "\u00df": "ss", "\u017f": "s", "\u0149": "\u02bcn", "\u01f0": "j\u030c", "\u1e96": "h\u0331", "\u1e97": "t\u0308", "\u1e98": "w\u030a", "\u1e99": "y\u030a",
    "\u1e9a": "a\u02be", "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
}

# Signs replaced after normal form, and signs that are dropped.
SIGNS = {
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-",
    "\u00a0": " ", "\u202f": " ", "\u2007": " ", "\u2022": "-", "\u25cf": "-", "\u25aa": "-", "\u2043": "-",
}
UNSEEN = "\u200b\u200c\u200d\u2060\ufeff" + "".join(chr(c) for c in range(32) if c not in (9, 10, 13)) + "\x7f"

# Lines that are furniture of a page, whole or in part.
PAGE_NUMBER = r"^(?:page\s*[:\-]?\s*\d+\s*(?:of\s*\d+)?|\d+\s*/\s*\d+)$"
CLASSIFICATION = r"^(?:classification|classified|confidential|internal use only|strictly confidential)\b"
COPYRIGHT = r"(?:©|copyright)\s*\d{4}"
VERSION_NOTE = r"\bversion\s+\d+(?:\.\d+)*\b"
NUMBER_LINES = (r"^page\s+\d+\s+of\s+\d+\s*$", r"^page\s*[:\-]?\s*\d+\s*$", r"^\d+\s*/\s*\d+\s*$", r"^page\s+\d+\s+of\s+\d+\s*[|\-].*$")

# Categories of questions, in the order in which they are tried.
CATEGORIES = (
    ("cross_document", (r"\brelated\b.+\bdocument\b", r"\breferenced\b", r"\bcross[\s-]?reference\b", r"\bwhich document\b", r"\bother\b.+\bpolicy\b")),
    ("compliance", (r"\baml\b", r"\bkyc\b", r"\bcompliance\b", r"\bregulat", r"\banti[\s-]?money\b")),
    ("security", (r"\bsecurity\b", r"\bcyber\b", r"\bvpn\b", r"\bmfa\b", r"\bpassword\b", r"\baccess control\b")),
    ("financial", (r"\brevenue\b", r"\bbudget\b", r"\bfinancial\b", r"\bquarterly\b", r"\bearnings\b", r"\bprofit\b", r"\bfiscal\b")),
    ("table", (r"\btable\b", r"\bmatrix\b", r"\bbreakdown\b")),
    ("comparison", (r"\bcompare\b", r"\bcomparison\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference\b")),
    ("list", (r"^\s*list\b", r"\bwhat are the\b", r"\bwhich\b.+\bare\b", r"\benumerate\b")),
    ("numeric", (r"\bhow many\b", r"\bhow much\b", r"\btotal\b", r"\bcount\b", r"\bpercentage\b", r"\bpercent\b")),
    ("procedure", (r"\bprocedure\b", r"\bprocess\b", r"\bworkflow\b", r"\bsop\b", r"\bstep\b", r"\bapproval\b")),
    ("policy", (r"\bpolicy\b", r"\bguideline\b", r"\bstandard\b", r"\bhandbook\b")),
    ("entity_lookup", (r"^\s*who is\b", r"^\s*where is\b", r"\bheadquarters\b", r"\bceo\b", r"\bcto\b", r"\bcfo\b", r"\bexecutive\b", r"\blocated\b")),
    ("definition", (r"^\s*what is\b", r"^\s*what are\b", r"^\s*define\b", r"^\s*explain\b")),
)
CONFIDENCE = {
    "cross_document": 0.88, "compliance": 0.86, "security": 0.84, "financial": 0.84, "table": 0.83, "comparison": 0.82, "list": 0.81,
    "numeric": 0.8, "procedure": 0.78, "policy": 0.77, "entity_lookup": 0.76, "definition": 0.74, "general": 0.55,
}

# What a question looks for in the structure of documents, in the order in which they are tried.
INTENTS = (
    ("table_intent", (r"\btable\b", r"\bmatrix\b", r"\bbreakdown\b", r"\bcomparison\b")),
    ("numeric_intent", (r"\bhow many\b", r"\bhow much\b", r"\btotal\b", r"\bcount\b", r"\bpercentage\b", r"\bpercent\b", r"\brevenue\b", r"\bbudget\b")),
    ("section_lookup", (r"\bsection\b", r"\bchapter\b", r"\bstrategic priorit", r"\bpolicy\b", r"\bappendix\b", r"\boverview\b")),
    ("list_intent", (r"^\s*list\b", r"\benumerate\b", r"\bwhat are the\b", r"\bwhich\b.+\bare\b")),
    ("entity_lookup", (r"^\s*what is\b", r"^\s*who is\b", r"^\s*where is\b", r"^\s*what are\b", r"\bheadquarters\b", r"\blocated\b")),
)

# Intents of a plan with the confidence of one hit (0.03 more for each further one).
PLAN_INTENTS = (
    ("count_query", 0.92, (r"\bhow many\b", r"\bcount\b", r"\bnumber of\b")),
    ("comparison", 0.9, (r"\bcompare\b", r"\bdifference between\b", r"\bvs\.?\b", r"\bversus\b")),
    ("summary_request", 0.88, (r"\bsummar(y|ize|ise)\b", r"\boverview\b", r"\btl;?dr\b")),
    ("version_lookup", 0.9, (r"\blatest\b", r"\boldest\b", r"\bversion\b", r"\bv\d+\b", r"\bfinal\b", r"\bprevious version\b")),
    ("relationship_query", 0.88, (r"\brelated to\b", r"\breferences?\b", r"\blinked to\b", r"\bdepends on\b", r"\brelationship\b")),
    ("navigation", 0.75, (r"\bshow (me )?(all|the) (path|taxonomy|collection|category)\b", r"\bnavigate\b", r"\bbrowse\b", r"\bunder\b")),
    ("policy_lookup", 0.85, (r"\bpolicy\b", r"\bpolicies\b", r"\bhandbook\b")),
    ("department_search", 0.8, (r"\bhr\b", r"\bfinance\b", r"\bsecurity\b", r"\bit\b", r"\blegal\b", r"\bdepartment\b")),
    ("collection_search", 0.78, (r"\bcollection\b", r"\bin finance\b", r"\bin hr\b", r"\bin security\b")),
    ("entity_search", 0.78, (r"\bmfa\b", r"\bvpn\b", r"\bemployee\b", r"\bcompany\b", r"\bincident\b", r"\bentity\b")),
    ("topic_search", 0.7, (r"\btopic\b", r"\babout\b", r"\bregarding\b")),
    ("keyword_search", 0.72, (r"\bkeyword\b", r"\bcontaining\b", r"\bmentions?\b")),
    ("metadata_search", 0.86, (r"\bfilename\b", r"\buploaded\b", r"\bowner\b", r"\blanguage\b", r"\bextension\b", r"\bmetadata\b")),
    ("document_lookup", 0.8, (r"\bfind (the )?document\b", r"\bget (the )?document\b", r"\bshow (me )?(the )?doc", r"\.pdf\b", r"\.docx?\b")),
)

# A legitimate frame, in which a question is safe whatever else it says, and what is unsafe without one.
LEGITIMATE = (
    r"\b(policy|policies|procedure|procedures|handbook|guideline|guidelines|training|code\s+of\s+conduct|what\s+does\s+our|what\s+is\s+our|"
    r"according\s+to\s+(?:the|our)|workplace\s+(?:harassment|violence|safety)|employee\s+(?:drug|conduct|safety))\b"
)
UNSAFE = (
    r"\bhow\s+(?:do|can|to|would)\s+(?:i|we|you)\s+(?:make|build|create|assemble)\s+(?:a\s+)?(?:bomb|explosive|pipe\s*bomb)\b",
    r"\bhow\s+(?:do|can|to)\s+(?:i|we)\s+(?:poison|murder|assassinate)\b",
    r"\b(?:write|give|show)\s+(?:me\s+)?(?:detailed\s+)?(?:instructions|steps)\s+(?:for|on)\s+(?:making|building)\s+(?:a\s+)?(?:bomb|explosive|weapon)\b",
    r"\bhow\s+(?:do|can|to)\s+(?:i|we)\s+(?:hack|break\s+into)\s+(?:someone(?:'s)?|a\s+stranger(?:'s)?)\s+(?:email|bank|account|wifi|phone)\b",
    r"\b(?:child\s*porn|csam|underage\s+sex(?:ual)?\s+(?:content|images|photos))\b",
    r"\bhow\s+(?:do|can|to)\s+(?:i|we)\s+(?:cover\s+up|hide)\s+(?:a\s+)?(?:murder|crime|assault)\b",
)

# Acronyms and synonyms that widen a question.
ACRONYMS = {
    "HQ": "headquarters", "CEO": "chief executive officer", "CTO": "chief technology officer", "CFO": "chief financial officer",
    "COO": "chief operating officer", "HR": "human resources", "IT": "information technology", "RBAC": "role based access control",
    "AML": "anti money laundering", "KYC": "know your customer", "BCP": "business continuity plan", "DR": "disaster recovery",
    "SOP": "standard operating procedure", "VPN": "virtual private network", "MFA": "multi factor authentication",
}
SYNONYMS = {
    "headquarters": ("office", "location", "corporate office", "branch"), "employee": ("staff", "associate", "personnel"),
    "finance": ("financial", "fiscal"), "policy": ("guideline", "standard"), "procedure": ("process", "workflow", "sop"),
    "revenue": ("income", "earnings"), "budget": ("allocation", "spending plan"), "security": ("cybersecurity", "information security"),
    "compliance": ("regulatory", "regulation"), "vendor": ("supplier", "third party"), "complaint": ("grievance", "dispute"),
    "loan": ("mortgage", "credit facility"), "risk": ("exposure", "threat"),
}

# By category of question, multipliers of the keyword and vector weight and of the bonus, size of the reranked pool, depth.
STRATEGIES = {
    "entity_lookup": (1.25, 0.9, 1.0, 12, 0.85),
    "definition": (1.1, 1.1, 1.15, 20, 1.0),
    "numeric": (1.45, 0.85, 1.0, 20, 1.0),
    "financial": (1.5, 0.8, 1.05, 20, 1.1),
    "policy": (1.15, 1.0, 1.35, 20, 1.0),
    "procedure": (1.2, 0.95, 1.2, 20, 1.0),
    "security": (1.25, 0.95, 1.25, 20, 1.0),
    "compliance": (1.3, 0.9, 1.3, 20, 1.0),
}

# Which categories of documents a role may see, and the category of a file by its name.
ROLE_CATEGORIES = {"admin": ("hr", "finance", "security", "employee", "general"), "hr": ("hr", "employee", "general"), "finance": ("finance", "general"), "employee": ("hr", "general")}
FILE_CATEGORIES = {
    "hr_policy": "hr", "employee_handbook": "hr", "leave_policies": "hr", "remote_work_policy": "hr", "performance_review_policy": "hr",
    "finance_report": "finance", "quarterly_reports": "finance", "department_budgets": "finance", "revenue_reports": "finance", "expense_reports": "finance",
    "security_logs": "security", "security_policy": "security", "mfa_policy": "security", "password_policy": "security", "incident_response": "security",
    "employees": "employee", "it_security_policy": "security",
}
MASTHEAD = r"enterprise governance\s+(?:policy|standard|guide|reference|matrix|document)"

# Phrases of departments, of document types (with the score of one hit), and what file names say about the type.
DEPARTMENTS = (
    ("HR", ("human resources", "hr policy", "hr department", "parental leave", "performance review", "employee handbook")),
    ("Finance", ("budget", "revenue report", "expense report", "fiscal year", "quarterly report", "accounting")),
    ("Security", ("security policy", "mfa", "password policy", "incident response", "threat", "vulnerability")),
    ("IT", ("information technology", "it policy", "helpdesk", "service desk", "vpn access")),
    ("Legal", ("legal department", "legal counsel", "attorney", "non-disclosure", "regulatory compliance")),
    ("Engineering", ("engineering team", "software engineering", "code review", "deployment pipeline")),
    ("Marketing", ("marketing campaign", "brand guidelines", "go-to-market")),
    ("Sales", ("sales pipeline", "sales quota", "opportunity stage")),
    ("Operations", ("operations team", "on-call rotation", "service level agreement")),
    ("Support", ("customer support", "support ticket", "support team")),
    ("Admin", ("administration office", "admin policy", "office management")),
)
TYPES = (
    ("Handbook", 0.95, ("handbook", "employee handbook", "staff handbook")),
    ("Policy", 0.9, ("policy", "policies", "policy manual", "code of conduct")),
    ("Financial Report", 0.88, ("financial report", "quarterly report", "revenue", "budget", "expense report")),
    ("Contract", 0.9, ("contract", "agreement", "terms and conditions", "msa", "nda")),
    ("Invoice", 0.92, ("invoice", "billing statement", "amount due")),
    ("Resume", 0.9, ("resume", "curriculum vitae", "cv ", "work experience")),
    ("Research Paper", 0.8, ("abstract", "references", "methodology", "literature review")),
    ("Presentation", 0.75, ("slide", "agenda", "deck", "presentation")),
    ("Manual", 0.85, ("manual", "runbook", "playbook", "how to", "procedure")),
)
TYPE_NAMES = (
    ("Handbook", ("handbook",)),
    ("Policy", ("policy", "policies")),
    ("Financial Report", ("finance", "budget", "revenue", "expense", "quarterly")),
    ("Contract", ("contract", "agreement", "nda")),
    ("Invoice", ("invoice",)),
    ("Resume", ("resume", "cv")),
    ("Manual", ("manual", "runbook", "incident_response")),
)
TYPE_COLLECTIONS = {"Research Paper": "research", "Financial Report": "finance", "Invoice": "finance", "Contract": "legal", "Resume": "personal"}

# Weights of what speaks for a candidate besides its similarity, and the most that they add.
HEADING_WEIGHT, TITLE_WEIGHT, PATH_WEIGHT, TYPE_WEIGHT = 0.04, 0.05, 0.03, 0.04
TABLE_BOOST, LIST_BOOST, HEADER_BOOST, PARAGRAPH_BOOST, NUMERIC_BOOST = 0.05, 0.05, 0.04, 0.04, 0.03
SAME_SECTION, SAME_SOURCE, ADJACENT, MOST_BONUS = 0.03, 0.02, 0.02, 0.15

# How much a kind of edge says.
EDGE_WEIGHTS = {
    "duplicate_of": 1.4, "previous_version": 1.3, "next_version": 1.3, "governs": 1.25, "references": 1.15, "mentions": 1.05,
    "same_taxonomy": 1.2, "same_department": 1.1, "same_collection": 1.05, "contains_entity": 1.0, "contains_topic": 0.95,
    "related_to": 0.9, "belongs_to": 0.85, "extends": 1.1,
}

# Versions in file names (first final, then draft, then these), and what is no part of the name.
VERSIONS = (r"[_\-\s]v(\d+)(?:\b|_)", r"\brev(?:ision)?[_\-\s]?(\d+)\b", r"\bversion[_\-\s]?(\d+)\b", r"[_\-](\d{1,2})(?:\.[a-z]+)?$")
VERSION_SUFFIX = r"([_\-\s]v\d+|_\d{1,2}|[_\-\s]final|[_\-\s]draft|[_\-\s]copy|[_\-\s]rev\d+)$"
NAME_STOPWORDS = ("policy", "policies", "report", "reports", "doc", "document")

# Concepts and the words that stand for them.
CONCEPTS = (
    ("Annual Leave", ("leave", "leaves", "vacation", "paid leave", "annual leave", "time off", "pto")),
    ("VPN", ("vpn", "virtual private network", "corporate vpn", "company vpn")),
    ("Multi-Factor Authentication", ("mfa", "2fa", "two factor", "multi factor authentication", "multi-factor authentication")),
    ("Remote Work", ("remote work", "work from home", "wfh", "hybrid work", "telework")),
    ("Incident Response", ("incident response", "security incident", "ir playbook", "breach response")),
    ("Performance Review", ("performance review", "performance management", "appraisal")),
    ("Budget", ("budget", "budgets", "budgeting", "department budget")),
    ("Expense Report", ("expense", "expenses", "expense report", "expense reports", "reimbursement")),
)
# The part of the taxonomy that a type of document belongs to.
BUCKETS = {
    "Policy": "Policies", "Handbook": "Handbooks", "Manual": "Procedures", "Financial Report": "Reports", "Invoice": "Invoices",
    "Contract": "Contracts", "Research Paper": "Papers", "Resume": "Resumes", "Presentation": "Presentations",
}
# Edges that an expansion of a graph follows, by its mode.
EXPANSIONS = {
    "taxonomy": ("same_taxonomy", "belongs_to"),
    "entity": ("contains_entity", "mentions"),
    "department": ("same_department",),
    "version": ("previous_version", "next_version", "duplicate_of", "belongs_to"),
    "relationship": ("related_to", "references", "governs", "extends", "mentions"),
}
# What an index adds to a candidate, once for each piece of evidence.
INDEX_POINTS = {"department": 1.2, "collection": 1.0, "taxonomy": 1.1, "entity": 1.0, "relationship": 1.3, "version": 0.8}
EXACT_METADATA, LATEST_VERSION = 1.5, 1.4

# Words that do not count when an answer is held against its evidence, and those that say nothing in a question.
GROUNDING_STOPWORDS = (
    "that", "this", "with", "from", "have", "been", "will", "your", "their",
    "about", "which", "when", "where", "what", "than", "then", "into", "also",
    "must", "shall", "should", "would", "could", "company", "document",
    "financial", "services", "internal", "classification",
)
QUESTION_STOPWORDS = (
    "what", "when", "where", "which", "who", "whom", "whose", "how",
    "the", "and", "for", "are", "was", "were", "with", "from", "that",
    "this", "about", "does", "have", "has", "had", "any", "there",
    "show", "tell", "give", "please", "list",
)

# Periods of time and identifiers of documents.
PERIOD = (
    r"\b(q[1-4]\s*20\d{2}|h[12]\s*20\d{2}|fy\s*20\d{2}|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+20\d{2}|"
    r"20\d{2}\s*(?:q[1-4]|h[12])|20(?:2[6-9]|[3-9]\d))\b"
)
DOCUMENT_ID = r"\b[A-Z]{2,}(?:-[A-Z0-9]{2,}){1,3}-\d{2,}\b"

# Table and list lines, and where a new section ends them.
BOUNDARY = r"^(?:(?:Section|Chapter|Appendix|Annex)\s+[\dIVXLC]+\b|\d+\.\d+(?:\.\d+)*\s+\S|\d+\.\s+[A-Za-z])"
BULLET, ORDERED = r"^[-*]\s+(.+)$", r"^(?:\d+|[a-zA-Z])[.)]\s+(.+)$"
LIST_DEPTH, TABLE_CONFIDENCE = 6, 0.55

# Kinds of structure that a passage may have, in the order in which they are tried.
STRUCTURES = (
    ("taxonomy", r"\b(taxonomy|hierarchy|level\s*[1-4]|l[1-4]\b)"),
    ("metadata_schema", r"\b(metadata (?:categor|schema|field|standard)|administrative metadata|business metadata)"),
    ("approval_flow", r"\b(approval (?:flow|path|authority|matrix)|who (?:approves|must approve)|delegated authority)"),
    ("escalation", r"\b(escalat)"),
    ("committee", r"\b(committee|charter|board)\b"),
    ("lifecycle", r"\b(lifecycle|life cycle|retention|archive|publication)"),
    ("workflow", r"\b(workflow|process flow|journey|step[- ]by[- ]step)"),
    ("timeline", r"\b(timeline|chronolog|effective date|milestone)"),
    ("policy", r"\b(policy|procedure|standard)\b"),
    ("governance", r"\b(governance|oversight|mandate)\b"),
    ("responsibilities", r"\b(responsib|raci|accountable|owner)\b"),
    ("decision_tree", r"\b(decision tree|if .+ then|decision path)\b"),
    ("comparison", r"\b(compar|versus|vs\.?|difference)\b"),
    ("relationship", r"\b(relationship|work together|mapping|related to)\b"),
    ("appendix", r"\b(appendix)\b"),
    ("examples", r"\b(example|for example|e\.g\.)\b"),
    ("definition", r"\b(mission|vision|definition|what is|means)\b"),
    ("list", r"\b(categories|types of|includes?:|core values)\b"),
)

# How an answer should be laid out, in the order in which they are tried.
ANSWERS = (
    ("comparison", r"\b(compare|comparison|contrast|difference|differences|vs\.?|versus|similarit(?:y|ies)|differ from)\b"),
    ("workflow", r"\b(journey|end[- ]to[- ]end|from\b.+\bto\b|workflow|process flow|step[- ]by[- ]step|ordered steps|complete (?:process|governance)|lifecycle|stages of)\b|\bdescribe the complete\b"),
    ("relationship", r"\b(work together|relate|relationship|relationships|interact|interrelate|connected|how .+ supports?|hierarchy .+ support|link between|connection between)\b"),
    ("summary", r"\b(summarize|summary|overview of|high[- ]level overview|brief overview)\b"),
    ("decision_guidance", r"\b(which (?:committee|body|authority|role|person)|who should|should approve|who (?:approves|owns)|recommend(?:ed)? (?:committee|approver|path)|which .+ should|approval path)\b"),
    ("list_extraction", r"\b(what are (?:the )?(?:different )?(?:categories|types|kinds|levels|values|components|elements|items)|list (?:the|all)|categories of|types of|enumerate|connections must|must every .{0,40} declare)\b"),
    ("troubleshooting", r"\b(troubleshoot|troubleshooting|why (?:is|does|did|can.?t|won.?t)|not working|error|issue|fix|root cause|diagnos)\b"),
    ("compliance", r"\b(complian(?:ce|t)|regulatory|regulation|obligation|obligations|must comply|control requirement|audit (?:requirement|evidence))\b"),
    ("policy_lookup", r"\b(policy)\b.+\b(require|requirement|scope|exception|apply|applies|must|shall|retention period|allowed|prohibited)\b|\b(requirements|scope|exceptions) of (?:the )?.+\bpolicy\b|\baccording to (?:the )?.+\bpolicy\b"),
    ("governance", r"\b(governance|committee charter|oversight|mandate|board|delegated authority|enterprise committee)\b"),
    ("reference_lookup", r"\b(document id|doc(?:ument)? code|filename|file name|where (?:is|can i find)|which document|reference (?:id|number)|identifier format)\b"),
    ("definition", r"\b(what is|what'?s|define|definition of|meaning of)\b"),
)
REFUSAL = r"\b(could(?:\s*|\s+)not find|couldn't find|no (?:document|documents|information|policy)|not (?:found|available|defined) in|do not have (?:enough|any)|insufficient)\b"
ENUMERATION = r"(?:according to|per|from)\s+[A-Za-z0-9_\-]+\.pdf|[A-Za-z0-9_\-]+\.pdf\s+(?:states?|says?|notes?|explains?|describes?)|\bdocument\s+[a-c]\s+says\b"
STAGES = ("creation", "metadata", "classification", "naming", "review", "approval", "publication", "retention", "archive")

# The indexes that the first intent of a plan needs.
INTENT_INDEXES = {
    "document_lookup": ("metadata", "keyword"), "metadata_search": ("metadata",), "collection_search": ("collection", "metadata"), "department_search": ("department", "taxonomy"),
    "entity_search": ("entity", "keyword"), "topic_search": ("topic", "keyword"), "keyword_search": ("keyword", "topic"), "version_lookup": ("version", "metadata", "taxonomy"),
    "relationship_query": ("relationship", "entity", "metadata"), "navigation": ("taxonomy", "collection"), "count_query": ("metadata", "collection"),
    "summary_request": ("metadata", "topic", "keyword"), "comparison": ("metadata", "relationship", "version"), "policy_lookup": ("taxonomy", "department", "keyword", "metadata"),
    "unknown": ("keyword", "metadata"),
}
# Constraints that a question sets.
LATEST, OLDEST = r"\blatest\b|\bmost recent\b|\bcurrent\b", r"\boldest\b|\bearliest\b|\bfirst version\b"
BEFORE, AFTER = r"\bbefore\s+(\d{4}(?:[-/]\d{1,2}[-/]\d{1,2})?)", r"\bafter\s+(\d{4}(?:[-/]\d{1,2}[-/]\d{1,2})?)"
LANGUAGE = r"\b(?:in|language)\s+(english|spanish|french|german|hindi)\b"
# States from which a failed document may be tried again.
RETRYABLE = ("failed", "retry_pending")

# Words that show that evidence bears on a type of answer, and the kinds of structure that suit it.
PRIMARY_WORDS = {
    "definition": ("mission", "vision", "core values", "values", "definition", "purpose", "meaning"),
    "list_extraction": ("categor", "types", "list", "levels", "connections", "metadata", "taxonomy"),
    "workflow": ("lifecycle", "creation", "draft", "approval", "publication", "retention", "archive", "version", "workflow", "journey", "process"),
    "relationship": ("relationship", "identifier", "filename", "version", "naming", "hierarchy", "supports", "mapping"),
    "governance": ("governance", "committee", "charter", "mandate", "oversight", "escalat"),
    "decision_guidance": ("committee", "approv", "authority", "decision", "who should", "escalat"),
    "policy_lookup": ("policy", "require", "scope", "exception", "retention", "must", "shall"),
    "compliance": ("compliance", "obligation", "regulatory", "control"),
    "comparison": ("compar", "difference", "versus", "similar"),
    "explanation": ("how", "explain", "process", "component"),
    "summary": ("overview", "summary"),
    "reference_lookup": ("document id", "filename", "identifier", "where"),
    "troubleshooting": ("error", "issue", "cause", "fix"),
}
SUITED_KINDS = {
    "definition": ("definition", "list"),
    "list_extraction": ("list", "table", "metadata_schema", "taxonomy"),
    "workflow": ("workflow", "lifecycle", "approval_flow", "timeline"),
    "relationship": ("relationship", "hierarchy", "taxonomy"),
    "governance": ("governance", "committee", "escalation"),
    "decision_guidance": ("approval_flow", "committee", "decision_tree", "escalation"),
    "policy_lookup": ("policy",),
    "compliance": ("policy", "governance"),
}
# What makes evidence support an answer, and what is beside the point unless the question asks for it.
SUPPORTING = (r"\b(example|for example|e\.g\.)\b", r"\b(responsib|raci|owner|accountable)\b", r"\b(exception|note|notes|context)\b", r"\b(naming|metadata)\b")
ASIDES = (
    r"\b(history|historical|background)\b",
    r"\b(headquarters|hq|geographic presence|branches?)\b",
    r"\b(appendix|abbreviations?|acronyms?)\b",
    r"\b(related documents?|references?|see also)\b",
    r"\b(employee structure|job levels|titles by function)\b",
)
