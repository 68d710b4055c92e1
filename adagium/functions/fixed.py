"""Word lists, patterns and tables that define the features' results.

Patterns are written in the common subset of Java and RE2 regular expressions,
so that plans and their SQL oracles share them.
"""

# ---- fixed values: corpus schema -------------------------------------------------------------
CORPUS_COLUMNS = (
    "id", "language", "resource_level", "proverb_native", "proverb_en", "fig_or_literal", "mk_theme",
    "proverb_type", "prescriptive_or_descriptive", "structural_pattern", "crosslingual_type_id",
    "source_dataset", "source_url", "license", "human_machine_labelled",
)
REQUIRED_COLUMNS = ("id", "language", "proverb_native", "source_dataset")
EDGE_PUNCTUATION = " !?.,;:፣።፥፤፦…-–—'\"“”‘’()[]"
TIGHT_PUNCTUATION = "!?.,;:፣።፥፤፦"
QUOTES = "\"'“”‘’`"
RESOURCE_LEVELS = ("high", "medium", "low")
SPLIT_SIZES = (("train", 0.64), ("val", 0.16), ("test", 0.20))
AGREEMENT_FLOOR = 0.40
KNN_K = 15

# ---- fixed values: imperative starters, version 1 and 2, and the rules engine's list ----------
IMPERATIVES_V1 = "make|keep|look|take|give|put|let|strike|cut|count|cast|spare|seize|know|mind|measure|hope|live|save|beware|trust|speak|act|think|leave|hold|walk|run|judge|praise|help|prepare|choose|learn|honou?r|respect|obey|forgive|remember|ask|answer|catch|marry|waste|want|do|be|have|use|try|call|eat|drink|buy|sell|pay|work|strike"
IMPERATIVES_V2 = "make|keep|look|take|give|put|let|strike|cut|count|cast|spare|seize|know|mind|measure|hope|live|save|beware|trust|speak|act|think|leave|hold|walk|run|judge|praise|help|prepare|choose|learn|honou?r|respect|obey|forgive|remember|ask|answer|catch|marry|waste|want|do|be|have|use|try|call|eat|drink|buy|sell|pay|work|chastise|forge|practice|hear|see|sow|reap"
STARTERS = (
    "look", "make", "keep", "waste", "want", "strike", "cut", "count", "cast", "spare", "seize", "know", "mind",
    "measure", "hope", "live", "give", "take", "put", "catch", "save", "beware", "trust", "speak", "act", "think",
    "leave", "hold", "walk", "run", "fear", "love", "hate", "judge", "praise",
)
PREFIX_CUES = r"(?i)(?:^|[,;:.]\s*)\s*(?:don'?t\b|do not\b|never\b|let\b|let'?s\b)"
NOT_NOT = r"(?i)\bnot\b.*,.*\bnot\b"

# ---- fixed values: feature patterns -----------------------------------------------------------
PROHIBITION = r"(?i)(?:^|[,;:]\s*)(?:never|don'?t|do not|let not|not to be)\b"
WASTE_NOT = r"(?i)\b\w+ not, \w+ not\b"
MODAL = r"(?i)\b(?:should|must|ought to|had better|have to|shalt)\b"
CONDITIONAL_V1 = r"(?i)(?:^(?:if|when|where)\b|\b(?:he|she|one|they|who(?:ever)?) who\b|^who(?:ever)? \w+)"
CONDITIONAL_V2 = r"(?i)(?:^(?:if|when|where)\b|\b(?:he|she|one|they) who\b|\bwho(?:ever)? \w+)"
CAUSAL = r"(?i)\b(?:causes?|brings?|breeds?|draws?|makes?|leads? to|begets?|creates?|produces?|results? in|ends? in)\b"
VALUATION = r"(?i)(?:\bbetter\b.*\bthan\b|\bworse\b.*\bthan\b|\bbest\b|\bas good as\b|\bis worth\b|\bworth more\b|\benough\b.*\bthan\b|\bis (?:a |an )?(?:rich|precious|valuable|great|treasure)\b)"
AGENCY = r"(?i)(?:\byou(?:r)?\b|\bthyself?\b|\bthy\b|\bthee\b|\b(?:he|she|one|they) who\b|\bwhoever\b|\b(?:marry|marries|lie[sd]?|speak|work|give|take|help|save|spend|borrow|lend|steal|plant|sow|reap|build|learn|teach|wait|hurry|rush|persist|practice)\b)"
POSITIVE = r"(?i)\b(?:good|well|reward|success|succeed|gain|profit|wealth|rich(?:es)?|wise|wisdom|blessing|blessed|honou?r|fortune|thrive|prosper|safe|safety|peace|friend|win|victor|heal|health|strong|sweet|golden|catch(?:es)? the)\b"
NEGATIVE = r"(?i)\b(?:repent|regret|shame|ruin|harm|hurt|loss|lose|poor|poverty|fool(?:ish)?|danger|fall|fail|starve|hunger|weep|cry|sorrow|grief|pain|punish|beaten|eaten|devour|trap|fleas|sad|bitter|die[sd]?|death|sting|burn|drown|thorn|enemy|spoil)\b"
EMBEDDED_ENGLISH = r"(?i)\b(the|is|are|was|were|has|have|had|who|will|would|when|never|always|nothing|everything|said|says|better|than|cannot|himself|themselves|land|those|walk|person|people|rich|poor|horse|donkey|thorn|body|money|bones|meat|ground|cattle|woman|market|honey|disease|nose|tree|relatives?)\b"

# ---- fixed values: canonical rewriting, in order: id, family, pattern, replacement ($n groups) --
CANONICAL_RULES = (
    ("we_better_1", "comparison", r"(?i)^(?:it'?s )?better (?:to )?(.+?) than (?:to )?(.+?)\.?$", "Better $1 than $2."),
    ("we_better_2", "comparison", r"(?i)^(.+?) is better than (.+?)\.?$", "Better $1 than $2."),
    ("we_prefer", "comparison", r"(?i)^prefer (.+?) (?:over|to) (.+?)\.?$", "Better $1 than $2."),
    ("ext_better_3", "comparison", r"(?i)^(.+?) (?:is|are) (?:worth more|more valuable) than (.+?)\.?$", "Better $1 than $2."),
    ("ext_as_good", "comparison", r"(?i)^(?:one )?(.+?) is as good as (.+?)\.?$", "Equal $1 and $2."),
    ("ext_no_x_y_good", "comparison", r"(?i)^(?:if |when )?(?:there (?:are|is) )?no (.+?),\s*(.+?) (?:is|are) (?:also )?good\.?$", "Better $2 than nothing when no $1."),
    ("ext_best", "valuation", r"(?i)^(?:the )?best (.+?) (?:is|are) (.+?)\.?$", "$2 is valued as best $1."),
    ("ext_is_rich", "valuation", r"(?i)^(?:a |an )?(.+?) is (?:a |an )?(rich|precious|valuable|great|good) (.+?)\.?$", "$1 is valued as $2 $3."),
    ("we_avoid_1", "prohibition", r"(?i)^(?:you should )?(?:never|don'?t|do not|cannot|can'?t|avoid) (.+?)\.?$", "Avoid $1."),
    ("we_avoid_2", "prohibition", r"(?i)^(?:it'?s )?(?:bad|wrong|dangerous) to (.+?)\.?$", "Avoid $1."),
    ("we_cond_1", "conditional", r"(?i)^(?:when|if) (.+?), (?:then )?(.+?)\.?$", "If $1, then $2."),
    ("we_cond_2", "conditional", r"(?i)^where (?:there'?s|you (?:have|find)) (.+?), (?:there'?s|you (?:have|find)) (.+?)\.?$", "If there is $1, there is $2."),
    ("ext_hewho", "conditional", r"(?i)^(?:he|she|they|one) who (.+?)(?:,| shall| will) (.+?)\.?$", "If a person $1, then that person $2."),
    ("ext_cause", "causal", r"(?i)^(.+?) (?:causes?|brings?|breeds?|draws?|makes?|leads? to) (.+?)\.?$", "$1 causes $2."),
    ("we_early", "causal", r"(?i)^(?:the )?early (.+?) (?:gets?|catches?) (?:the )?(.+?)\.?$", "Early action brings $2."),
    ("we_practice", "causal", r"(?i)^(?:practice|repetition) makes? (?:perfect|improvement)\.?$", "Practice improves skill."),
    ("we_time", "valuation", r"(?i)^time (?:is|equals?) (?:money|wealth|value)\.?$", "Time has value."),
    ("we_hands", "causal", r"(?i)^(?:many|multiple|several) hands (?:make|create) (?:light work|easy work)\.?$", "Cooperation reduces effort."),
    ("we_unity", "causal", r"(?i)^(?:together|unity) (?:we|is) (?:stand|strength)(?:, (?:divided|apart) (?:we )?fall)?\.?$", "Unity creates strength."),
    ("we_excess", "causal", r"(?i)^too (?:many|much) (.+?) (?:spoils?|ruins?) (?:the )?(.+?)\.?$", "Excess of $1 harms $2."),
    ("we_balance", "prohibition", r"(?i)^(?:all work|only work) and no play makes? (.+?) (?:a )?(?:dull|boring) (?:boy|person)\.?$", "Balance work and rest."),
    ("we_haste", "causal", r"(?i)^(?:haste|rushing|hurrying) (?:makes|creates|causes) (?:waste|mistakes|errors)\.?$", "Haste causes problems."),
    ("we_steady", "causal", r"(?i)^(?:slow and )?steady wins (?:the )?race\.?$", "Consistency beats speed."),
    ("we_patience", "causal", r"(?i)^(?:good things|patience) (?:comes?|rewards) (?:to )?(?:those who|people who) wait\.?$", "Patience brings rewards."),
    (
        "ext_imperative",
        "imperative",
        r"(?i)^((?:make|keep|look|take|give|put|let|strike|cut|count|cast|spare|seize|know|mind|measure|hope|live|save|beware|trust|speak|act|think|leave|hold|walk|run|judge|praise|help|prepare|waste|want|marry|choose|learn|honou?r|respect|obey|forgive|remember|ask|answer|strike|catch) .+?)\.?$",
        "Do: $1.",
    ),
)
LEAD_IN = r"(?i)^(old saying:|proverb:|they say:?|it is said:?|english equivalent:?)\s*"
ORIGIN_SUFFIX = r"(?i)\s*(- \w+ proverb|- \w+ saying)\.?$"
#: family: (is_command, has_valuation, has_cause_result)
FAMILY_HINTS = {"imperative": (1, 0, 0), "prohibition": (1, 0, 0), "comparison": (0, 1, 0), "valuation": (0, 1, 0), "conditional": (0, 0, 1), "causal": (0, 0, 1), "none": (0, 0, 0)}

# ---- fixed values: book parsing ----------------------------------------------------------------
INDEX_TOKENS = ("see", "see also", "i.e", "i. e", "e.g", "cf", "or", "we say", "viz", "ditto", "meaning", "so", "scotch", "scotice", "hamburg", "moses", "knows", "of", "give", "ironical")
INDEX_PAGE = r",\s*\d{1,3}\s*[—–-]?\s*$"
BOOK_END = r"(?m)^[ \t]*(?:GENERAL |ENGLISH )?INDEX\.?[ \t]*$|\*\*\*\s*END OF TH"

# ---- fixed values: reply formats ----------------------------------------------------------------
FORM_WORDS = ("prescriptive", "descriptive")  # codes 0 and 1
FORM_LINE = r"(?i)form\s*:\s*(prescriptive|descriptive)"
IMPLICIT_LINE = r"(?i)implicit\s*:\s*(yes|no)"
CODE_LINE = r"(?i)code\s*:\s*([A-Za-z0-9]+)"
SALVAGE_CODE = r"[A-Z]\d[a-z]?"
LABEL_NEAR = r"(?i)label\D{0,5}([01])"
COMMAND_CUES = ("don't", "do not", "never", "always", "must", "should", "let ", "keep ", "make ", "take ")
