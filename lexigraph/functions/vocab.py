"""Closed vocabularies of box notation."""

# Fixed values of the notation; they must stay as they are for parsing to agree.
BOX_INDICATORS = (
    "ALTERNATION ATTRIBUTION CONDITION CONSEQUENCE CONTINUATION CONTRAST EXPLANATION NECESSITY NEGATION "
    "POSSIBILITY PRECONDITION RESULT SOURCE CONJUNCTION ELABORATION CORRECTION"
).split()
OPERATORS = "TSU MOR BOT TOP ESU EPR EQU NEQ APX LES LEQ TPR TAB TIN SZP SZN SXP SXN STI STO SY1 SY2 SXY ANA TCT".split()
INVERTIBLE_ROLES = "InstanceOf AttributeOf ColourOf ContentOf PartOf SubOf ThemeOf TimeOf AgentOf MannerOf".split()
ROLES = (
    "InstanceOf Proposition Name Agent AgentOf Asset Attribute AttributeOf Affectee Beneficiary Causer Co-Agent Co-Patient "
    "Co-Theme Consumer Destination Duration Experiencer Finish Frequency Goal Instrument Instance Location Manner MannerOf "
    "Material Path Patient Pivot Product Recipient Result Source Start Stimulus Theme ThemeOf Time TimeOf Topic Value Bearer "
    "Colour ColourOf ContentOf Content Creator Degree MadeOf Of Operand Owner Part PartOf Player Quantity Role Sub SubOf "
    "Title Unit User ClockTime DayOfMonth DayOfWeek Decade MonthOfYear YearOfCentury Affector Context Equal Extent "
    "Precondition Measure Cause Order Participant FeatureOf"
).split()
CONSTANTS = "speaker hearer now unknown_ref monday tuesday wednesday thursday friday saturday sunday".split()
SYNSET = r"(.+)\.(n|v|a|r|x)\.(\d+)"
INDEX = r"((-|\+|<|>)\d)"
NAME = r"\"(.+)\"|\"(.+)"
BE_FORMS = "be am is are being was were".split()
STATUSES = "success ill_formed parse_error gold_error smatch_error".split()
MODAL_LEMMAS = "can could may might must shall should will would ought".split()
NOMINAL_DEPENDENCIES = "nsubj nsubjpass dobj pobj obj attr appos compound poss".split()
MASKS = {
    "role": (r":([A-Z][a-z]*)", ":role"),
    "relation": (r":([A-Z]{4,12}) ", ":relation "),
    "operator": (r":([A-Z]\{3\}) ", ":operator "),
    "sense": (r"(.+)\.(n|v|a|r)\.\d+", "$1"),
}
BE_NODE = r"\bbe\.[a-z]\.[0-9]+\b"
BE_VERBS = "(?:be|am|is|are|being|was|were)"
ADJECTIVE = r"\b[a-z_]+\.a\.[0-9]+\b"
ADVERB = r"\b[a-z_]+\.r\.[0-9]+\b"
VERB = r"\b([a-z_]+\.v\.[0-9]+)\b"
ROLE_WORD = r"\bRole\b"
COMPARATIVE = r"\b(?:more|less|as)\.r\.[0-9]+\b"
EXISTENTIAL = r"(?i)\bthere\s+(?:is|are|was|were|'s|'re)\b"
WH_LOCATIVE = r"(?i)\bwhere\s+(?:is|are|was|were)\b"
PROGRESSIVE = rf"(?i)\b{BE_VERBS}\b\s+(?:\w+\s+)?\w+ing\b"
PASSIVE_BY = rf"(?i)\b{BE_VERBS}\b\s+\w+(?:ed|en)\b.*\bby\b"
CONSTRUCTIONS = {
    "auxiliary": "auxiliary (lexical verb present)",
    "comparative": "adjectival — comparative",
    "equative": "nominal / equative (predicate noun)",
    "adjective": "adjectival — predicate adjective",
    "adverb": "adverbial — predicate adverb",
    "other": "locative / existential / measure (no other predicate)",
}
# End of the fixed values.
