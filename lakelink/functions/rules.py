"""Rule tables of the normalising tokenizer and of the linkers.

Fixed values: the word lists, patterns and replacements in this module must have these values for results
to be right. Patterns are for Java's regular expressions; `$1` is a group. Order matters in every table.
"""

from __future__ import annotations

# --- Fixed values: basic preprocessing ---
STOP_WORDS = r"\bof\b|\bat\b|\bby\b|\bon\b|\bthe\b|\bfrom\b|\band\b|\bis\b|\bin\b|\ban\b|\bwith\b|\bby\b|\bfor\b|\bit\b|\bas\b|\bbetween\b|\bbased\b"
HTML_TAG = r"<[^>]+>"
PLURAL = r"(?<!s)(?<!mea)(?<!michaeli)s\b"
BIOAVAILABILITY_PLURAL = r"bioavailabilities|bioavailabilitie"
HALF_LIFE_PLURAL = r"half[\s\-_]*(lives|live|times)"

# --- Fixed values: words removed ---
CHEMICALS = ("glucose", "inulin", "lactose", "sucrose", "fructose", "galactose", "mannitol", "creatinine", "bilirubin", "cortisol", "testosterone", "estradiol", "progesterone", "insulin", "cholesterol", "triglycerides", "ffa", "vitamin", "folate", "biotin", "caffeine", "theobromine", "nicotine", "ethanol", "hemoglobin", "albumin", "total protein")
TOKEN_REMOVALS = ("h", "hr", "hours", "hour", "min", "mins", "minutes", "seconds", "s", "secs", "day", "days", "week", "weeks", "month", "months", "time", "obs", "ob", "observed", "systemic", "to", "period", "compartment", "level")
SPECIAL_CHARACTERS = {"λ": "lambda", "α": "alpha", "β": "beta", "γ": "gamma", "%": "percentage", "z": "zeta", "θ": "theta"}

# --- Fixed values: general rewrites, in order ---
GENERAL = (
    ("[‐‑‒–—―−﹘﹣－]", "-"),
    (r"--+", "-"),
    (r"\b(1st|primary)\b", "first"),
    (r"\b(2nd|secondary)\b", "second"),
    (r"\b(3rd|tertiary)\b", "third"),
    (r"\bzero\b", "0"),
    (r"∞|infinity", "inf"),
    (r"(?<=\d),(?=\d{3}\b)", ""),
    (r"\bfraction\b", "percentage"),
    (r"\b(\d+)\s*time\b", "$1"),
    (r"(^|[\s\(\[\{.,;:-])(d|day)\s*(?=\d)", ""),
    (r"(\d+(\.\d+)?)\s*\bto\b\s*(\d+(\.\d+)?)|\b(\d+(\.\d+)?)\s*\bto\b\s*(inf|t|last)\b", "$1$5-$3$7"),
    (r"\(\s*(\d+)\s*,\s*([^)]+)\)", "$1-$2"),
    (r"(\d+(\.\d+)?)\s*-\s*(\d+(\.\d+)?)|(\d+(\.\d+)?)\s*-\s*(inf|t)", "$1$5-$3$7"),
    (r"^\b([a-zA-Z]) ([a-zA-Z]+)\b", "$1$2"),
    (r"(\b[a-zA-Z]+)\(\s*([a-zA-Z]+)\s*\)", "$1$2"),
    (r"\bdistributional\b", "distribution"),
    (r"\bperiperhal\b", "peripheral"),
    (r"\b(?:steady[\s\-]state)\b", "ss"),
    (r"(?-i)(τ|tau)", "t"),
    (r"\b(?:normalized|normalised|normalize|normalise|norm)\b", "normalised"),
    (r"(maximal|maximum)", "max"),
    (r"(minimum|minimal)", "min"),
    (r"bloavailability", "bioavailability"),
    (r"t\s*\(*?\s*l\s*/\s*2\s*\)?", "t1/2"),
    (r"^(θ|theta|tv)", ""),
    (r"_f\b|/\s*f|/\s*bioavailability\b|\bbioavailability[\s\-\_]+normalised\b|\bbioavailability[\s\-\_]+adjusted\b", " bionorm "),
    (r"\b\d+\s*kg\b", " "),
    (r"/dose(\d|[a-zA-Z])?\b|/d\b|dose[\s\-\_]+normalised|\(\s*dn\s*\)|per[\s\-\_]+dose|normalised", " dosenorm "),
    (r"_", " "),
    (r"\b(fluid|plasma|serum|cerebrospinal|csf|urine|feces|saliva|bile|gastric|sputum|breast\s*milk|lung|subcutaneous|sweat|tears)\b", ""),
    (r"\b(?:(tv|θ)(?=\s*\w))", ""),
    (r"\b(?:dose|drug|body|total|value|observed|compartment|observed)\b", ""),
    (r"\b(?<!-)(auc|aumc|mrt|c|vd|v|t)(tend|all|tlast|last|inf|ss|z|t)\b", "$1 $2"),
)

# --- Fixed values: parameter rewrites, in order of application ---
PARAMETERS = (
    (r"\b(?:concentration|concn)\b", "c"),
    (r"\b(?:area[\s\-_]*under\s+.*?\s*curve|(?:systemic[\s\-_]*)exposure|total[\s\-_]*exposure|exposure|auc\s*to)\b", "auc"),
    (r"\b(?:auc[\w–\-\,\s]*\/\s*auc[\w–\-\,\s]*|auc[\s\-_]?r|auc[\s\-_]?dr|relative[\s\-_]?auc|auc[\s\-_]?interaction[\s\-_]?ratio|parent[\s\-:_]*metabolite[\s\-_]*(?:auc[\s\-_]*)?ratio)\b", "auc ratio"),
    (r"(?:last[\s\-\_]*(measurable|measured)[\s\-\_]*c|last[\s\-\_]*(?:obs|meas)|0-(?:tend|tlast|last)|\ball|\btend|\btlast|\blast)\b", " last"),
    (r"\b(?:auc[\s\-_]*(\d+(?:\.\d+)?)(?![.\d-])\s*(?:hours|hour|hr|h|days|day|d|minutes|min?)?|auc[\s\-\_]*(?:d|day)(\d+)|interval\s+auc)\b", "auc t"),
    (r"\b(?:(?:auc[\s\-_]*)?first[\s\-_]*moment[\s\-_]*(curve)?)\b", "aumc"),
    (r"\b(?:renal[\s\-_]*bioavailability)\b", "fr"),
    (r"\b(?:gut[\s\-_]*wall[\s\-_]*bioavailability)\b", "fg"),
    (r"\b(?:hepatic[\s\-_]*bioavailability)\b", "fh"),
    (r"\b(?:relative\s+(?:bioavailability|systemic\s+availability))\b", "frel"),
    (r"\b(?:(?:absolute\s+)?(?:oral\s+)?bioavailability|percentage\s+absorbed|systemic\s+availability|f[\s\-_]*(abs|ab|a)|f(?!\S))\b", " f "),
    (r"\b(?:(clearance|cl)[\s\-]*rate|(?:total\s+)?clearance|elimination[\s\-]*cl|cl(total|tot|t)|clp|cl(?!\d+-\d+)\d+|\(\s*cl\s*\))\b", "cl"),
    (r"\b(?:(renal|urinary)[\s\-]*cl|cl[,\s\-]*r)\b", "clr"),
    (r"\b(?:blood[\s\-]*cl|cl[,\s\-]*b)\b", "clb"),
    (r"\b(?:nonrenal[\s\-]*cl|cl[,\s\-]*nr)\b", "clnr"),
    (r"\b(?:unbound[\s\-]*cl|cl[,\s\-]*u)\b", "clu"),
    (r"\b(?:intrinsic[\s\-]*metabolic[\s\-]*cl|intrinsic[\s\-]*cl|enzyme[\s\-]*mediated[\s\-]*cl|intrinsic[\s\-]*clint|cl[,\s\-]*int)\b", "clint"),
    (r"\b(?:hepatic[\s\-]*cl|cl[,\s\-]*h)\b", "clh"),
    (r"\b(?:cl[\s\-_]*(?:po|(zeta|z))|(?:oral|apparent)(?:[\s\-_]*(oral|apparent))?[\s\-_]*cl)\b", "cl bionorm"),
    (r"\b(?:inter[\s\-]*compartment(?:al)?[\s\-\_]*cl(\s*central\s*peripheral)?|q\s*(?:p)?\s*1|first[\s\-]*inter[\s\-]*compartment(?:al)?[\s\-\_]*cl|distribution(?:al)?[\s\-\_]*cl)\b", "q"),
    (r"\b(?:q\s*central[\s\-]*second[\s\-]*peripheral|q\s*(?:p)?\s*2|second[\s\-]*q)\b", "q2"),
    (r"\b(?:time(?:[\s\-_]*(to[\s\-_]*reach|to))?)\b", "t"),
    (r"\b(?:(?:(max|peak)[\s\-_]*)?t(?:[\s\-_](cmax|c))|t[\s\-_]*(?:max|peak)(?:[\s\-_]*c)?|t[\s\-_]*cmax|t[\s\-_]*(max)|(?:max|peak)[\s\-_]*t)\b", "tmax"),
    (r"\b(?:alag|absorption\s*lag\s*t|lag\s*t)\b", "tlag"),
    (r"\b(?:mean\s*residence\s*t|average\s*residence\s*(time|t)|mrt0-[a-zA-Z]+|mrt[a-zA-Z]+)\b", "mrt"),
    (r"\b(?:m\s*tt|mean\s*transit\s*t)", "mtt"),
    (r"\b(?:mean\s*absorption\s*(time|t)|average\s*absorption\s*(time|t)|mat)\b", "mat"),
    (r"\b(?:c\s?\(?(?![^)]*-)(?!0)[0-9]+\s?(?:hr|h|hours|days|day|minutes|mins|min|')?\)?|day\s*\d+\s*c|c\s*day\s*\d+|c[\s\-]*(d|day)[\s\-]*\d+)\b", "c t"),
    (r"\b(?:c[\s\-_]*peak(\d|[a-zA-Z])?|c[\s\-_]*max(\d|[a-zA-Z])?|peak(\s*c)?|max(?:imum|imal)?\s*(?:c|level|peak)|cp[\s\-_]*max)\b", "cmax"),
    (r"\b(?:min(?:imum|imal)?\s*c|c[\s\-_]*min(\d|[a-zA-Z])?)\b", "cmin"),
    (r"\b(?:c[\s\-_]*trough|c[\s\-_]*pre|pre[\s\-_]*level|trough(?:[\s\-_]*(c|level))?)\b", "ctrough"),
    (r"\b(?:c[\s\-_]*0|extrapolated[\s\-_]*c)\b", "c0"),
    (r"\b(?:c[\s\-_]*average|c[\s\-_]*(avg|ave|av)(?:[\s\-_,]*\d+)?|average[\s\-_]*c)\b", "cavg"),
    (r"\b(?:v[\s\-_]*z|v[\s\-_]*d|v[\s\-_]*beta|v[\s\-_]*gamma|distribution\s*volume|volume\s*distribution|volume|v)\b", "v"),
    (r"\b(?:v[\s\-_]*1|v[\s\-_]*c|central[\s\-_]*v|v[\s\-_]*central)\b", "v1"),
    (r"\b(?:v[\s\-_]*3|v[\s\-_]*p[\s\-_]*2|second[\s\-_]?peripheral[\s\-_]?v)\b", "v3"),
    (r"\b(?:v[\s\-_]*p(?:1)?|v[\s\-_]*2|peripheral[\s\-_]*v)\b", "v2"),
    (r"(?:\b(?:half[\s\-\_]*(life|lives|live|time|t)|hl)\b|t\s*\(*?\s*1\s*/\s*2\s*\)?|t[\s\-\_]*0.5)", "t1/2"),
    (r"\b(?:(?:initial|fast|first|early|distribution|alpha)(?:[\s\-_]*phase)?[\s\-_]*t1/2|t1/2[\s\-_]*(?:initial|fast|first|early|distribution|alpha)(?:[\s\-_]*phase)?|(distribution)[\s\-_]*t1/2|t1/2[\s\-_]*distribution)\b", "t1/2 alpha"),
    (r"\b(?:(?:secondary|second|slow|beta|late|latter)(?:[\s\-_]*phase)?[\s\-_]*t1/2|t1/2[\s\-_]*(?:secondary|second|slow|beta|late|latter)(?:[\s\-_]*phase)?|t1/2[\s\-_]*calculated[\s\-_]*beta[\s\-_]*slope)\b", "t1/2 beta"),
    (r"\b(?:(?:tertiary|third|gamma)(?:[\s\-_]*phase)?[\s\-_]*t1/2|t1/2[\s\-_]*(?:tertiary|third|gamma)(?:[\s\-_]*phase)?|t1/2[\s\-_]*calculated[\s\-_]*gamma[\s\-_]*slope)\b", "t1/2 gamma"),
    (r"\b(?:absorption(?:[\s\-_]*phase)?[\s\-_]*t1/2|t1/2[\s\-_]*absorption(?:[\s\-_]*phase)?|t1/2[\s,/-]*(?:abs|ab|a)|k[\s\-_]*01[\s\-_]*t1/2)\b", "t1/2,ka"),
    (r"\b(?:(apparent|terminal)[\s\-_]*(?:(elimination|disposition|terminal)[\s\-_]*)?t1/2(?:[\s\-_]*(elimination|disposition))?|(elimination|disposition|terminal)[\s\-_]*t1/2|terminal(?:[\s\-_]*phase)?[\s\-_]*t1/2|t1/2[\s\-_]*terminal(?:[\s\-_]*phase)?|t1/2(?:[\s,/-]*(?:elimination|el|apparent|app|terminal|λ(zeta|z)|(zeta|z)|ke))|k[\s\-_]*10[\s\-_]*t1/2|effective[\s\-_]*t1/2)\b", "t1/2"),
    (r"\b(?:terminal([\s\-_]*phase)?)\b", "z"),
    (r"\b(?:rate[\s\-_]*constant)\b", " k "),
    (r"\b(?:k[\s\-_]*(?:absorption|abs|ab|a|01)|(?:first[\s\-_]*order\s*)?absorption[\s\-_]*(k|rate)|rate[\s\-_]*absorption)\b", " kabs "),
    (r"\b(?:(?:urinary[\s\-_]*)?excretion[\s\-_]*(k|rate)|(k|rate)[\s\-_]*excr(?:etion)?)\b", " kexcr "),
    (r"\b(?:metabolite[\s\-_]*elimination[\s\-_]*(k|rate)|k[\s\-_]*met(?:abolite)?)\b", " kmet "),
    (r"\b(?:k[\s\-_]*(?:elimination|el|e|10)|rate[\s\-_]*elimination|elimination[\s\-_]*constant|(?:first[\s\-_]*order\s*)?elimination[\s\-_]*(k|rate)|(lambda|λ)[\s\-_]*(zeta|z)|(lambda|λ))\b", " kel "),
    (r"\b(?:(transfer|distribution)\s*(k|rate)\s*(central\s*(?:to\s*)?peripheral|(central\s*(?:to\s*)?second\s*peripheral|peripheral\s*(?:to\s*)?central|second\s*peripheral\s*(?:to\s*)?central)?)|(k|rate)\s*(transfer|distribution)\s*(central\s*(?:to\s*)?peripheral|(central\s*(?:to\s*)?second\s*peripheral|peripheral\s*(?:to\s*)?central|second\s*peripheral\s*(?:to\s*)?central)?)|k[\s\-_]*(12|21|13|31|24|42|23|32|34|43)\b)\b", " kcomp "),
    (r"\b(?:cumulative[\s\-_]*excretion[\s\-_]*amount|amount[\s\-_]*excreted)\b", " ae "),
    (r"\b(?:percentage[\s\-_]*excreted[\s\-_]*unchanged|(cumulative[\s\-_]*)?(urinary|fecal)[\s\-_]*(excretion|excr|recovery(\s*rate)?)|renal[\s\-_]*(excretion|excr)|(excretion|excr))\b", " fe "),
    (r"\b(?:michaelis[\s‐\-]*menten[\s‐\-]*(constant)?)\b", " km "),
    (r"\b(?:max(?:imum|imal)?[\s\-_]*enzyme[\s\-_]*activity)\b", " vmax "),
    (r"\b(?:hepatic[\s\-_]*extraction[\s\-_]*ratio)\b", " eh "),
    (r"\b(?:extraction[\s\-_]*ratio)\b", " e "),
    (r"\b(?:metabolic[\s\-_]*conversion[\s\-_]*percentage)\b", " fm "),
    (r"\b(?:percentage[\s\-_]*unbound|percentage[\s\-_]*protein[\s\-_]*unbound|free[\s\-_]*percentage|protein[\s\-_]*binding[\s\-_]*ratio|protein[\s\-_]*binding)\b", " fu "),
    (r"\b(?:blood[\s\-_]*flow)\b", " blood flow "),
)

# --- Fixed values: last rewrites, token extraction, token standards ---
TAIL = (
    (r"\bc\s*(?:versus|vs|[-:/])\s*t\b|\bcxt\b", ""),
    (r"\b(?:phase)\b", ""),
    (r"\b(?:apparent|app|z)\b", "bionorm"),
)
TOKEN = r"t[\s\_]*1/2|\d+/\d+|[a-zA-Z]+(?=\d+-)|\d+(?:\.\d+)?\s*-\s*[a-zA-Z]+|\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?|\b[a-zA-Z]\d{1}\b|[a-zA-Z]+|\d+(?:\.\d+)?|[%λαβγ]"
STANDARDS = (
    (r"\b(?:ave|av|avg|mean)\b", "average"),
    (r"\b(ext|extrap)\b", "extrapolated"),
    (r"0-\d+(?:\.\d+)?", "t"),
    (r"0-t", "t"),
    (r"0-inf", "inf"),
    (r"0-last", "last"),
)
NUMERIC_RANGE = r"^\d+(?:\.\d+)?-\d+(?:\.\d+)?$"

# --- Fixed values: mentions that are no parameters ---
EXCLUDED = (
    r"\bmic\b", r"\bminimum[\s\-_]*inhibitory[\s\-_]*concentration\b", r"\bceoinf\b", r"\bcl[\s\-_/:]*(cr|creatinine)\b",
    r"\bauc[\s\-_/:]*mic", r"\bauc\d+(\.\d+)?[\s\-_/:]*mic", r"\bauc\d+(\.\d+)?\s*[-–]\s*\d+(\.\d+)?[\s\-_/:]*mic", r"\bauc\d+(\.\d+)?(\s*[-–]\s*\d+(\.\d+)?)?[a-z]{1,2}\b[\s\-_/:]*mic",
    r"\beffective[\s\-_]*concentration\b", r"\beffective[\s\-_]*half[\s\-_]*life\b", r"\binhibitory[\s\-_]*concentration\b",
    r"\bic[\s\-_]*50\b", r"\bec[\s\-_]*50\b", r"\be[\s\-_]*max\b", r"\bi[\s\-_]*max\b", r"\bk[\s\-_]*off\b", r"\bk[\s\-_]*on\b",
    r"\bgfr\b", r"glomerular[\s\-_]*filtration[\s\-_]*rate", r"hill[\s\-_]*(slope|coefficient|constant)",
    r"\bp[\s\-_]*ka\b", r"\blog[\s\-_]*[pd]\b", r"\blog[\s\-_]*p\b", r"\bmolecular[\s\-_]*weight\b", r"\bmolecular[\s\-_]*mass\b", r"\bweight\b", r"\bmass\b",
    r"\bsolubility\b", r"\bpermeability\b", r"\bbinding[\s\-_]*affinity\b", r"therapeutic[\s\-_]*index",
    r"\btgf[-\s]*beta\b", r"\btnf[-\s]*alpha\b", r"\bcrp\b", r"\binterleukin\b", r"gene[\s\-_]*expression", r"\bmrna\b",
    r"\b(k[\s\-_]*d|k[\s\-_]*(tran|transit)|k[\s\-_]*feces|k[\s\-_]*i)\b", r"\bhvd\b", r"\barc[\s\-_]*trough\b", r"\bps[\s\-_]*dif\b", r"\bmtd\b",
)

# --- Fixed values: contexts that settle ambiguous mentions; (id, pattern) ---
NIL, NIL_CATEGORY = "Q100", "G100"
KM_CONTEXTS = (
    ("Q51", r"(?:1\s*/\s*h|h\s*[-⁻−]\s*1)"),
    ("Q1", r"\b(?:enzyme|michaelis[\s\-_]*menten|michaelis|menten|substrate|vmax|kinetic(?:s)?|affinity|saturation|nmol\s*(?:/|·|per)?\s*[lL](?:[-−⁻]1)?)\b"),
)
HALF_LIFE_CONTEXTS = (
    ("Q57", r"\b(?:non[\s\-_]*compartment(?:al)?|nca|1[\s\-_]*compartment(?:al)?|one[\s\-_]*compartment(?:al)?)\b"),
    ("Q60", r"\b(?:two[\s\-_]*compartment(?:al)?|2[\s\-_]*compartment(?:al)?|multi[\s\-_]*compartment(?:al)?|biphasic|slow[\s\-_]*phase|second[\s\-_]*phase|latter[\s\-_]*phase|beta[\s\-_]*phase)\b"),
    ("Q89", r"\b(?:gamma[\s\-_]*phase|triphasic|third[\s\-_]*phase|three[\s\-_]*compartment(?:al)?|3[\s\-_]*compartment(?:al)?)\b"),
)

# --- Fixed values: category and parameter patterns ---
CATEGORIES = (
    ("G1", r"(?:auc|aumc|area[\s\-_]*under)"),
    ("G2", r"(?:(?<![\w/])f(?!\w)|\bf[\s\-_]*r\b|\bf[\s\-_]*g|\bf[\s\-_]*h|\bf[\s\-_]*rel|\bf[\s\-_]*ab|bioavailability|absorption)"),
    ("G3", r"(?:\bcl|clearance|\bcl[\s\-_]*r|\bcl[\s\-_]*b|\bcl[\s\-_]*nr|\bcl[\s\-_]*u\b|\bcl[\s\-_]*h|(?<![\w/])q(?!\w)|\bq[\s\-_]*2|\bae|\bfe\b|excretion|excreted|recovery)"),
    ("G4", r"(?:concentration|\bc[\s\-_]*max|\bc[\s\-_]*0|\bc[\s\-_]*t|\bc[\s\-_]*min|\bc[\s\-_]*ss|\bc[\s\-_]*avg|\bc[\s\-_]*trough|peaked|peak|(?<![\w/])c\b)"),
    ("G5", r"(?:\bt[\s\-_]*1/2|half[\s\-_]*life)"),
    ("G6", r"(?:rate[\s\-_]constant|\bk[\s\-_]*el|\bk[\s\-_]*excr|\bk[\s\-_]*abs|\bk[\s\-_]*met|\bk[\s\-_]*m|\bk[\s\-_]*comp|(?<![\w/])k\b|alpha|beta\b)"),
    ("G7", r"(?:t[\s\-_]*max|t[\s\-_]*lag|t[\s\-_]*ss|ss[\s\-_]*t|mrt|(?<!\w)mat\b|mtt)"),
    ("G8", r"(?:volume|\bv[\s\-_]*1|\bv[\s\-_]*2|\bv[\s\-_]*3|(?<![\w/])v)"),
    ("G9", r"(?:\bv[\s\-_]*max|\bk[\s\-_]*m|\bf[\s\-_]*m|\bf[\s\-_]*u|\beh|(?<![\w/])e(?!\w)|blood[\s\-_]*flow|metabolic|metabolism|extraction|michaelis|enzyme|unbound)"),
)
PRIORITIES = (("G1", "G2", "G3", "G5"), ("G4", "G5", "G9", "G7"), ("G8", "G6"))
PARAMETER_GROUPS = (
    (r"ratio", ("Q21", "Q31", "Q33", "Q35", "Q58", "Q93")),
    (r"ss\b", ("Q18", "Q34", "Q72", "Q65")),
    (r"bionorm", ("Q27", "Q69", "Q80", "Q76", "Q290", "Q82", "Q78")),
    (r"dosenorm", ("Q189", "Q174")),
    (r"\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?", ("Q19",)),
    (r"\d+(?:\.\d+)?\s*-\s*[a-zA-Z]+", ("Q19", "Q18", "Q74", "Q17", "Q20", "Q189", "Q21")),
    (r"max\b", ("Q66", "Q56", "Q93", "Q32", "Q174", "Q33")),
)
