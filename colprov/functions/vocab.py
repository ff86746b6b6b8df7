"""The frozen vocabularies of the documentation sieve.

Each list is one alternation; the order within a list is the order in which the
alternatives are tried. They are the defaults of the operators and are passed as
parameters, so a sweep can be run with any other vocabulary.
"""

from __future__ import annotations

# flags: ignore case and read \w, \b, \s as Unicode
FLAGS = "(?iU)"


def alternation(patterns: list[str], flags: str = FLAGS) -> str:
    return f"{flags}({'|'.join(patterns)})"


# the source tells the reader not to use the column, or says it comes too late
WARN = [
    r"should (?:be )?(?:discard|remov|drop|exclud|omit|ignor|not be used|only be used)\w*",
    r"should not be (?:used|included|considered)",
    r"must be (?:discard|remov|drop|exclud|omit)\w*",
    r"(?:we|were|was|is|are) (?:therefore )?(?:discard|remov|drop|exclud|omit)\w* (?:from|because|since|as it|to avoid)",
    r"(?:not|never) (?:known|available|recorded|measured|observed) (?:before|prior to|at the time|until after)",
    r"only (?:known|available|obtained|determined) after",
    r"(?:known|available|obtained) only after",
    r"not (?:yet )?(?:known|available) (?:at|when|before)",
    r"for benchmark purposes",
    r"realistic predictive model",
    r"highly affects the (?:output|target|class)",
    r"(?:data|target|label|information) leak\w*",
    r"leaka?ge",
    r"circular(?:ity)?",
    r"unrealistic\w*",
    r"artificially (?:high|inflat\w+|good|optimistic)",
    r"(?:perfect|trivial|100%|near[- ]perfect)\w* (?:predict|accura|classif|separ)\w*",
    r"would (?:not )?be (?:available|known|cheating)",
    r"cheat\w*",
    r"(?:difficult|hard|harder|challenging) to (?:predict|classify|model)",
    r"(?:without|excluding|dropping|ignoring) (?:the )?(?:attribute|variable|feature|column)",
    r"strong(?:ly)? correlat\w* with",
    r"(?:this|which) occurs because",
    r"(?:no|little) predictive (?:value|use|merit)",
    r"(?:be|is|are|was|were) (?:used|useful) only (?:for|as)",
    r"(?:before|prior to) the (?:call|outcome|event|decision|prediction)",
    r"at the time of (?:enrol|admission|application|origination|screening)\w*",
]

# the source says the target itself was built from the column
DEFINE = [
    r"(?:class|label|target|outcome|diagnosis|grade|category|group)\w*\s+(?:was|were|is|are|has been)\s+(?:then\s+)?(?:assign|determin|deriv|comput|calculat|obtain|defin|creat|label|establish)\w*\s+(?:by|from|using|with|according to|on the basis of|based on)",
    r"(?:was|were|is|are) (?:used|taken) to (?:assign|determin|deriv|comput|calculat|defin|label|creat)\w*\s+(?:the )?(?:class|label|target|outcome|diagnosis|grade|categor)",
    r"(?:calculat|comput|deriv)\w* (?:the )?(?:class|label|target|outcome|categor)\w*\s+(?:by|from|using|with|as)",
    r"(?:sum|total|union|aggregate|combination) of the (?:remaining|other|above|preceding)",
    r"one of (?:the )?(?:two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:fault|defect|class|categor|type|pattern|outcome)",
    r"mutually exclusive",
    r"none of (?:the|these) (?:above|other|named|six|seven)",
    r"is set to 1 if (?:any|at least one)",
    r"equal to the (?:sum|product|ratio|difference)",
    r"(?:sum|total|number) of (?:the )?(?:crime|fault|defect|event|complication)\w*",
    r"1 if (?:any|at least one|one or more)",
    r"(?:indicator|flag|dummy) for (?:whether|the)",
]

# the verb phrase that follows a dataset's own target name
DEFINE_VERB = (
    r"(?:was|were|is|are|has been|have been)\s+(?:then\s+)?(?:assign|determin|deriv|comput|calculat|obtain|defin|creat|label|establish|set|construct|form)\w*\s+(?:by|from|using|with|as|according to|on the basis of|based on)"
)

# a condition, and a value given to something label-like
CONDITION = r"\b(?:if|when|whenever|where|unless|in case)\b"
ASSIGN = (
    r"(?:class|label|target|outcome|response|dependent variable|flag)\w*\s+(?:value\s+)?(?:is|was|are|were|has been|have been|becomes?|gets?)\s+(?:then\s+)?(?:set|assigned|coded|marked|flagged|given|put)\s+(?:to|as|equal to|=)\s*"
)
ASSIGN_VERB = (
    r"(?:['\"]?\s*(?:label|column|variable|field|flag)?)\s+(?:value\s+)?(?:is|was|are|were|has been|have been|becomes?)\s+(?:then\s+)?(?:set|assigned|coded|marked|flagged|given)\s+(?:to|as|equal to|=)"
)

# a heading that declares its block to be outcomes
OUTCOME_HEADING = (
    r"\b(complication|outcome|follow[- ]?up|post[- ](?:operative|treatment|discharge|infarction|transplant|intervention)|result[s]? of (?:the )?(?:treatment|therapy|surgery|procedure)|survival|mortalit(?:y|ies)|death|end[- ]?point|target (?:variable|attribute)|dependent variable|class attribute|response variable|what happened|event(?:s)? (?:during|after))s?\b"
)
NUMBERED_ROW = r"^\s*(\d{1,3})[.)]\s+(.*)$"
STATISTICS_ROW = r"(?i)^\s*(cases|missing|\d|[-+]?\d*\.?\d+%?)\b"

# the authors of a data dictionary warn the reader off
DICTIONARY_WARN = [
    r"should (not )?be (discarded|used|excluded)",
    r"only .{0,20}benchmark",
    r"not known before",
    r"realistic predictive model",
    r"leakage",
]

# timing or derivation phrases with what they express, first match wins
EXPLICIT = [
    (r"predicted by a model", "DERIVED"),
    (r"\bpost[- ]charge[- ]?off\b", "AFTER_EVENT"),
    (r"days? (?:of|from|to) follow[-\s]?up", "AFTER_EVENT"),
    (r"follow[-\s]?up (?:period|time|days)", "AFTER_EVENT"),
    (r"cause of death", "AFTER_EVENT"),
    (r"\bat discharge\b", "AFTER_EVENT"),
    (r"from study entry to discharge", "AFTER_EVENT"),
    (r"(?:survival|mortality) (?:estimate|score|probability)", "DERIVED"),
    (r"\bat day \d+", "AFTER_EVENT"),
    (r"(?:recorded|measured|collected|assigned) after", "AFTER_EVENT"),
    (r"only .{0,25}after (?:the )?(?:outcome|event|discharge|call|charge)", "AFTER_EVENT"),
    (r"not known before", "WARNED"),
    (r"should (?:only be|be) (?:used|included|discarded)", "WARNED"),
    (r"realistic predictive model", "WARNED"),
    (r"after the (?:end of the |)(?:call|outcome|event|procedure|operation)", "AFTER_EVENT"),
    (r"(?:outcome|result) of (?:the )?(?:treatment|surgery|operation|procedure)", "AFTER_EVENT"),
    (r"\bpost[- ]?operative\b", "AFTER_EVENT"),
    (r"\bpost[- ]?treatment\b", "AFTER_EVENT"),
    (r"time (?:to|until) (?:death|event|failure|relapse)", "AFTER_EVENT"),
    (r"whether the patient (?:died|survived)", "AFTER_EVENT"),
    (r"(?:number|days) of (?:hospital )?stay", "AFTER_EVENT"),
]

# closed world: a phrase that on its own licenses the label
CLOSED_POST = [
    r"only known after|known only after|available only after",
    r"not (?:known|available|recorded) (?:until|before)",
    r"after (?:the )?(?:call|outcome|event|diagnosis|discharge|transplant|surgery|procedure|treatment|admission|death)",
    r"post[- ](?:operative|treatment|transplant|discharge|charge[- ]?off|intervention|surgery)",
    r"(?:time|days|duration|period)\s+(?:of|to|until)\s+\w+",
    r"(?:development|occurrence|onset|incidence) of ",
    r"follow[- ]?up (?:time|period|days|months|duration)",
    r"time[- ]to[- ]event|censor",
    r"length of stay",
    r"(?:recorded|measured|collected|assigned|determined) (?:at|after) (?:discharge|the end|follow)",
    r"during (?:the )?(?:follow[- ]?up|observation|survival) period",
    r"at (?:the )?end of (?:the )?(?:study|follow[- ]?up|observation|survival)",
]
CLOSED_DERIVED = [
    r"one of (?:the )?(?:two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:fault|defect|class|categor|type|outcome)",
    r"mutually exclusive|none of the (?:above|other|named)",
    r"used to (?:assign|define|determine|derive) the (?:class|label|target|outcome|diagnosis)",
    r"(?:the )?(?:class|label|target) (?:is |was )?(?:assigned|determined|derived|computed) (?:by|from|according to)",
    r"basis for the (?:class|diagnosis|outcome)",
]

# what an author says when a column is dropped, and why
ACTION = r"(exclud|remov|drop|discard|omit|delet|elimina|not\s+used|were\s+not\s+included)"
REASON = (
    r"(leak|data\s+snooping|look[-\s]?ahead|target\s+leak|future\s+information|not\s+available\s+at|unavailable\s+at|after\s+the\s+outcome|post[-\s]?outcome|only\s+known\s+after|determined\s+after|prior\s+to\s+prediction|would\s+not\s+be\s+known|realistic\s+predict)"
)
COLUMN_LIKE = r"\b(?:[a-z]+_[a-z0-9_]+|[A-Z]{2,}[0-9]*|[a-z]+[A-Z][a-zA-Z]*)\b"
IDENTIFIER = (
    r"\b(identifier|patient[_ ]?(id|nbr)|encounter[_ ]?id|record[_ ]?id|\bids?\b|primary key|index column)"
)
STATEMENT_TIMING = (
    r"(only known after|known only after|available only after|after the (call|outcome|event|diagnosis|discharge|procedure|surgery)|not (?:be )?(?:known|available|recorded) (?:until|before|at)|recorded (?:after|post)|measured after|collected after|determined after|assigned after|subsequent to the outcome|posterior to|not available at (?:the )?(?:time of )?prediction)"
)
NAMED_COLUMN = r"\b(?:variable|feature|attribute|column|field)s?\b[^.]{0,60}|such as the \w+"

# a dictionary row: a column-like name, then its description
DICTIONARY_ROW = (
    r"\b([A-Za-z][A-Za-z0-9]*(?:[_\-][A-Za-z0-9]+){0,4})\s+((?:[A-Z(]|[a-z])[^|]{12,150}?)(?=\s+[A-Za-z][A-Za-z0-9]*(?:[_\-][A-Za-z0-9]+){0,4}\s+[A-Z(]|$)"
)
ROW_STOP_NAMES = ["the", "and", "for", "with", "this", "table", "figure", "input", "value"]
ROW_EXTRA = (
    r"(time (?:of|to) (?:observation|event|failure|recur|death)|time[- ]to[- ]event|follow[- ]?up|until (?:development|the event)|duration until|at end of|during the .{0,20}period|if (?:the patient )?(?:died|dead|alive)|time period of|censor)"
)
ROW_TARGET = r"\b(class attribute|target|outcome variable|label|dependent variable|response variable)\b"

# anchored windows around a column name
ANCHOR_TIMING = (
    r"(time (?:of|to) (?:observation|event|failure|recur|death|relapse)|time[- ]to[- ]event|follow[- ]?up|until (?:development|the event)|duration until|at end of|during the .{0,25}period|censor|if (?:the patient )?(?:died|dead|alive|survived)|time period of|only known after|known only after|after the (?:call|outcome|event|diagnosis|discharge|procedure|surgery|transplant)|post[- ]?(?:transplant|operative|treatment)|recovery|survival)"
)
ANCHOR_REASON = (
    r"(one of (?:the )?(?:two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:fault|defect|class|categor|type|pattern|outcome)|mutually exclusive|none of the (?:above|other|named|six|seven)|remaining (?:fault|defect|class|categor|case)|assigned (?:by|from|based on|according to|on the basis of)|classified (?:as|into|according to|based on|on the basis of)|determined (?:by|from|on the basis of)|(?:label|labell?ed|coded|scored) (?:as|according to|based on|from)|derived from the|defined as (?:the )?(?:absence|presence|any|none)|used to (?:assign|define|determine|derive) the (?:class|label|target|outcome|diagnosis)|expert|obstetrician|clinician|annotator|adjudicat)"
)
DICTIONARY_LIKE = (
    r"(numerical|categorical|binary|numeric|input|attribute|variable|feature|days|months|years|yes,? ?no|0\s*[-,–]\s*1|class attribute|measured in|defined as|range)"
)

# what licenses a label: late in time, or the label defined by the column
TEMPORAL_LICENCE = (
    r"(time (?:of|to) (?:observation|event|failure|recurrence|recur|death|relapse)|time[- ]to[- ]event|(?:period|time) of follow[- ]?up|follow[- ]?up (?:period|time|month|day)|duration until|until (?:the )?development|(?:development|occurrence|onset) of (?:acute|chronic|extensive|the )|if (?:the )?(?:patient )?(?:died|dead|survived|alive)|at end of (?:the )?survival|during the (?:follow[- ]?up|survival|observation)|only known after|known only after|available only after|after the (?:call|outcome|event|diagnosis|discharge|transplant)|(?:time|days) (?:taken )?(?:for|to) (?:neutrophil|platelet|.{0,12})?recovery|recovery,? defined as|censor)"
)
REASON_LICENCE = (
    r"(one of (?:the )?(?:two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:fault|defect|class|categor|type|pattern|outcome)|mutually exclusive|none of the (?:above|other|named|six|seven)|remaining (?:fault|defect|class|categor|case)|assigned (?:by|from|based on|according to|on the basis of)|classified (?:as|into|according to|based on|on the basis of)|determined (?:by|from|on the basis of)|(?:label|labell?ed|coded|scored) (?:as|according to|based on|from)|derived from the|defined as (?:the )?(?:absence|presence|any|none)|used to (?:assign|define|determine|derive) the (?:class|label|target|outcome|diagnosis))"
)
NEXT_NAME = r"\s(?=[A-Za-z][A-Za-z0-9_]{3,}\s*[-–—]\s+[A-Za-z])|\s(?=[A-Z][A-Za-z0-9_\-]{3,}\s+[A-Z(])"
PROSE_LICENCE = r"(only known after|known only after|available only after|not available at|would not be known)"

# generated data
SYNTHETIC = (
    r"\b(synthetic|synthesised|synthesized|simulat\w+|artificially (?:generated|created)|fictional|fake data|generated using (?:faker|numpy|python|a script|gpt)|randomly generated|toy dataset|dummy data|mock data|not real (?:patient )?data|does not represent real)\b"
)

# claims in a report
PRIORITY_CLAIM = r"\b(the first\b|first benchmark|no (?:such )?benchmark|novel|unprecedented|nobody has|has never been|we are the first)\b"
UNIVERSAL_CLAIM = r"\b(all |every |each of|never|always|none of|only |exclusively|cannot|impossible|no [a-z]+ can)\b"
CAUSAL_CLAIM = r"\b(proves?|demonstrates? that|shows? that|establishes?|confirms? that|therefore|hence|because)\b"
