"""Inputs with known results for rules that the tables never reach; queries deal them to the rows of a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mentions and their canonical tokens.
MENTION_TOKENS = {
    # areas, moments and doses
    "Exposure": "auc", "areas under the curves": "auc", "AUC0–48 h": "auc t", "AUC 0 to last": "auc last", "AUC 24": "auc t", "first moment curve": "aumc", "dose-normalised AUC": "auc dosenorm", "AUC0-24h": "auc t",
    # words that are removed
    "glucose clearance": "cl", "Caffeine AUC": "auc", "plasma CL": "cl", " 70 kg V": "v", "<i>CL</i><sub>r</sub>": "clr", "12-24": "", "": "",
    # availability
    "absolute oral bioavailability": "f", "systemic availability": "f", "gut wall bioavailability": "fg", "F": "f", "relative bioavailability": "frel",
    # clearances
    "clearance rate": "cl", "urinary clearance": "clr", "CL,b": "clb", "unbound clearance": "clu", "nonrenal clearance": "clnr", "CLint": "clint", "CLz": "bionorm cl", "CL_F": "bionorm cl", "tvCL": "cl", "Q1": "q", "second inter-compartmental clearance": "q2",
    # concentrations
    "Cmax,ss": "cmax ss", "Cp max": "cmax", "C24h": "c t", "C min": "cmin", "C0": "c0", "average concentration": "cavg", "Ctrough level": "ctrough", "peak level": "cmax",
    # half-lives and rates
    "t1/2β": "beta t1/2", "t(1/2)": "t1/2", "t½": "t1/2", "secondary half-life": "beta t1/2", "third phase half-life": "gamma t1/2", "elimination half-lives": "t1/2", "HL": "t1/2",
    "first-order absorption rate constant": "kabs", "k10": "kel", "ke": "kel", "lambda z": "kel", "transfer rate central to peripheral": "kcomp", "excretion rate constant": "kexcr",
    # times and volumes
    "Tmax": "tmax", "lag times": "tlag", "MRT0-inf": "mrt", "mean absorption time": "mat", "V2/F": "bionorm v2", "Vz": "v", "volume of central compartment": "v1", "Vp1": "v2", "second peripheral volume": "v3", "steady state volume of distribution": "ss v",
    # others, special characters and standards
    "Vmax": "vmax", "maximum enzyme activity": "vmax", "fraction unbound": "fu", "hepatic extraction ratio": "eh", "amount excreted": "ae", "fraction excreted unchanged": "fe", "urinary recovery": "fe", "% absorbed": "absorbed percentage", "α": "alpha", "mean CL": "average cl", "avg Cmax": "average cmax",
}

#: What a mention may say, and whether it is no parameter.
EXCLUSIONS = {
    "MIC": True, "minimum inhibitory concentration": True, "CL/creatinine": True, "AUC/MIC": True, "AUC24/MIC": True, "AUC0-24/MIC": True, "effective half-life": True, "IC50": True, "EC 50": True, "Emax": True, "I-max": True, "koff": True, "k on": True,
    "GFR": True, "glomerular filtration rate": True, "Hill slope": True, "pKa": True, "log P": True, "molecular weight": True, "body mass": True, "solubility": True, "permeability": True, "binding affinity": True, "therapeutic index": True,
    "TGF-beta": True, "TNF alpha": True, "CRP": True, "interleukin 6": True, "gene expression": True, "mRNA": True, "Kd": True, "ktransit": True, "k feces": True, "Ki": True, "HVD": True, "MTD": True,
    "clearance": False, "AUC": False, "half-life": False, "hill": False, "mice": False, "Vmax": False, "masses": False,
}

#: Token strings and mentions, with the categories that count and, where there is none, the parameters.
CATEGORY_MATCHES = {
    # by tokens
    ("auc t", "AUC0-24"): ("G1", ""), ("cl bionorm", "CL/F"): ("G3", ""), ("c t", "concentration"): ("G4", ""), ("t1/2", "half-life"): ("G5", ""), ("v1", "volume"): ("G8", ""), ("mrt", "MRT"): ("G7", ""), ("kel", "k"): ("G6", ""), ("f", "F"): ("G2", ""), ("fm", "x"): ("G9", ""),
    # by the mention, where tokens have none
    ("xyz", "peak of it"): ("G4", ""), ("xyz", "rate constant"): ("G6", ""), ("xyz", "bioavailability"): ("G2", ""),
    # several: the first tier that is met
    ("km", "Km"): ("G9", ""), ("auc cmax", "AUC Cmax"): ("G1", ""), ("v k", "x"): ("G6,G8", ""), ("t1/2 v", "x"): ("G5", ""),
    # parameters, by tokens and by the mention
    ("ratio", "zz"): ("", "Q21,Q31,Q33,Q35,Q58,Q93"), ("zz ss", "zz"): ("", "Q18,Q34,Q65,Q72"), ("dosenorm", "zz"): ("", "Q174,Q189"), ("12-24", "zz"): ("", "Q19"), ("0-t", "zz"): ("", "Q17,Q18,Q189,Q19,Q20,Q21,Q74"), ("xmax", "zz"): ("", "Q174,Q32,Q33,Q56,Q66,Q93"), ("xyz", "a max"): ("", "Q174,Q32,Q33,Q56,Q66,Q93"),
    # nothing
    ("zzz", "zzz"): ("", ""),
}

#: Sentences, the mention they start with, and its status, prediction and open candidates.
AMBIGUOUS = {
    ("t1/2 in a two-compartment model", "t1/2"): ("disambiguated", "Q60", ""), ("t1/2 of one compartment", "t1/2"): ("disambiguated", "Q57", ""), ("t1/2 here", "t1/2"): ("disambiguated", "Q57", ""), ("t1/2 of a biphasic and triphasic", "t1/2"): ("multi", "Q100", "Q60,Q89"),
    ("Km alone", "Km"): ("multi", "Q100", "Q1"), ("Km of the enzyme", "Km"): ("disambiguated", "Q1", ""), ("Km in 1/h", "Km"): ("disambiguated", "Q51", ""), ("x here", "x"): ("unlinked", "Q100", "Q7,Q8"), ("zz", "zz"): ("unlinked", "Q100", ""),
    ("AUC/MIC here", "AUC"): ("excluded", "Q100", ""), ("CL was", "CL"): ("linked", "Q2", ""),
}


def dealt(values, key: str) -> Column:
    """The value whose turn it is by the key."""
    values = list(values)
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def dealt_sql(values, key: str) -> str:
    values = list(values)
    literal = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"[{', '.join(map(literal, values))}][{key} % {len(values)} + 1]"
