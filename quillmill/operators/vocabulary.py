"""The curated vocabulary that reports use unless another is given."""

from __future__ import annotations

#: The terms by key, with their name, other forms, category, name as an ingredient and forms in Korean speech.
TERMS: dict[str, dict] = {
    "ZINC_OXIDE": {
        "canonical_en": "zinc oxide",
        "aliases": ["zno", "zinc-oxide", "zinc oxides", "nano-zno", "nano zno", "zinc oxide nanoparticle", "zinc oxide nanoparticles"],
        "category": "uv_filter",
        "inci_en": "Zinc Oxide",
        "kr_colloquial": ["징크옥사이드", "징크", "무기자차", "산화아연"],
    },
    "TITANIUM_DIOXIDE": {
        "canonical_en": "titanium dioxide",
        "aliases": ["tio2", "tio₂", "titanium(iv) oxide", "titania", "titanium dioxides", "nano-tio2", "titanium dioxide nanoparticle", "titanium dioxide nanoparticles"],
        "category": "uv_filter",
        "inci_en": "Titanium Dioxide",
        "kr_colloquial": ["티타늄디옥사이드", "이산화티탄", "무기자차"],
    },
    "OCTOCRYLENE": {
        "canonical_en": "octocrylene",
        "aliases": ["octocrilene", "oc"],
        "category": "uv_filter",
        "inci_en": "Octocrylene",
        "kr_colloquial": ["옥토크릴렌"],
    },
    "AVOBENZONE": {
        "canonical_en": "avobenzone",
        "aliases": ["butyl methoxydibenzoylmethane", "bmdbm", "parsol 1789"],
        "category": "uv_filter",
        "inci_en": "Butyl Methoxydibenzoylmethane",
        "kr_colloquial": ["아보벤존"],
    },
    "OXYBENZONE": {
        "canonical_en": "oxybenzone",
        "aliases": ["benzophenone-3", "benzophenone 3", "bp-3", "obz"],
        "category": "uv_filter",
        "inci_en": "Benzophenone-3",
        "kr_colloquial": ["옥시벤존"],
    },
    "SPF": {
        "canonical_en": "sun protection factor",
        "aliases": ["spf", "sun-protection factor", "sun protection factors", "sunburn protection factor"],
        "category": "spec",
        "kr_colloquial": ["자차수치", "에스피에프"],
    },
    "UVA_PROTECTION": {
        "canonical_en": "UVA protection",
        "aliases": ["uva", "uv-a", "uva protection", "pa grade", "persistent pigment darkening", "ppd"],
        "category": "spec",
        "kr_colloquial": ["피에이", "자외선a"],
    },
    "UVB": {
        "canonical_en": "UVB radiation",
        "aliases": ["uvb", "uv-b", "uvb radiation", "ultraviolet b"],
        "category": "spec",
        "kr_colloquial": ["자외선b"],
    },
    "ULTRAVIOLET": {
        "canonical_en": "ultraviolet radiation",
        "aliases": ["uv", "ultraviolet", "uv radiation", "ultraviolet radiation", "uv light", "ultraviolet light"],
        "category": "spec",
        "kr_colloquial": ["자외선"],
    },
    "PHOTOPROTECTION": {
        "canonical_en": "photoprotection",
        "aliases": ["photo-protection", "photoprotective", "photoprotection mechanism", "photoprotective effect"],
        "category": "mechanism",
        "kr_colloquial": ["광보호"],
    },
    "HYALURONIC_ACID": {
        "canonical_en": "hyaluronic acid",
        "aliases": ["ha", "hyaluronan", "sodium hyaluronate", "hyaluronic acids"],
        "category": "ingredient",
        "inci_en": "Hyaluronic Acid",
        "kr_colloquial": ["히알루론산", "히알루론"],
    },
    "NIACINAMIDE": {
        "canonical_en": "niacinamide",
        "aliases": ["niacinamides"],
        "category": "ingredient",
        "inci_en": "Niacinamide",
        "kr_colloquial": ["나이아신아마이드", "나이아신"],
    },
    "NICOTINAMIDE": {
        "canonical_en": "nicotinamide",
        "aliases": ["nicotinamides", "vitamin b3 amide"],
        "category": "ingredient",
        "kr_colloquial": [],
    },
    "RETINOL": {
        "canonical_en": "retinol",
        "aliases": ["retinols", "vitamin a alcohol"],
        "category": "ingredient",
        "inci_en": "Retinol",
        "kr_colloquial": ["레티놀"],
    },
    "RETINOID": {
        "canonical_en": "retinoid",
        "aliases": ["retinoids", "tretinoin", "retinoic acid", "all-trans retinoic acid", "atra"],
        "category": "ingredient",
        "kr_colloquial": ["레티노이드"],
    },
    "SUPEROXIDE_DISMUTASE": {
        "canonical_en": "superoxide dismutase",
        "aliases": ["sod", "sods", "superoxide-dismutase", "cu/zn-sod", "cuznsod", "mn-sod", "mnsod", "superoxide dismutases"],
        "category": "enzyme",
        "kr_colloquial": [],
    },
    "EGF": {
        "canonical_en": "epidermal growth factor",
        "aliases": ["egf", "epidermal growth factors", "epidermal-growth-factor"],
        "category": "peptide",
        "kr_colloquial": ["이지에프", "성장인자"],
    },
    "PDRN": {
        "canonical_en": "polydeoxyribonucleotide",
        "aliases": ["pdrn", "polydeoxyribonucleotides", "polynucleotide", "pn"],
        "category": "peptide",
        "kr_colloquial": ["피디알엔", "연어주사"],
    },
    "ANTIOXIDANT": {
        "canonical_en": "antioxidant",
        "aliases": ["antioxidants", "anti-oxidant", "anti-oxidants", "antioxidant activity", "antioxidant capacity"],
        "category": "mechanism",
        "kr_colloquial": ["항산화"],
    },
    "ANTI_AGING": {
        "canonical_en": "anti-aging",
        "aliases": ["anti aging", "antiaging", "anti-ageing", "anti ageing", "antiageing", "aging", "ageing", "skin aging", "skin ageing", "photoaging", "photo-aging", "photoageing"],
        "category": "claim",
        "kr_colloquial": ["안티에이징", "노화"],
    },
    "NANOPARTICLE": {
        "canonical_en": "nanoparticle",
        "aliases": ["nanoparticles", "nano-particle", "nano-particles", "nanomaterial", "nanomaterials"],
        "category": "formulation",
        "kr_colloquial": ["나노입자"],
    },
    "LIPOSOME": {
        "canonical_en": "liposome",
        "aliases": ["liposomes", "liposomal", "liposomal delivery", "nanoliposome", "nanoliposomes"],
        "category": "formulation",
        "kr_colloquial": ["리포좀"],
    },
    "STRATUM_CORNEUM": {
        "canonical_en": "stratum corneum",
        "aliases": ["sc", "horny layer"],
        "category": "anatomy",
        "kr_colloquial": ["각질층"],
    },
    "SKIN_BARRIER": {
        "canonical_en": "skin barrier",
        "aliases": ["skin barriers", "epidermal barrier", "barrier function", "skin barrier function", "transepidermal water loss", "tewl"],
        "category": "mechanism",
        "kr_colloquial": ["피부장벽", "장벽"],
    },
    "MELANIN": {
        "canonical_en": "melanin",
        "aliases": ["melanins", "melanogenesis", "melanogenic"],
        "category": "mechanism",
        "kr_colloquial": ["멜라닌"],
    },
    "TYROSINASE": {
        "canonical_en": "tyrosinase",
        "aliases": ["tyrosinases", "tyrosinase inhibition", "tyrosinase inhibitor", "tyrosinase inhibitors"],
        "category": "enzyme",
        "kr_colloquial": [],
    },
    "CERAMIDE": {
        "canonical_en": "ceramide",
        "aliases": ["ceramides"],
        "category": "ingredient",
        "inci_en": "Ceramide NP",
        "kr_colloquial": ["세라마이드"],
    },
    "PEPTIDE": {
        "canonical_en": "peptide",
        "aliases": ["peptides", "bioactive peptide", "bioactive peptides", "oligopeptide", "oligopeptides"],
        "category": "ingredient",
        "kr_colloquial": ["펩타이드"],
    },
    "CENTELLA": {
        "canonical_en": "Centella asiatica",
        "aliases": ["centella", "centella asiatica", "madecassoside", "asiaticoside", "gotu kola"],
        "category": "ingredient",
        "kr_colloquial": ["시카", "센텔라", "병풀"],
    },
    "MICROBIOME": {
        "canonical_en": "skin microbiome",
        "aliases": ["microbiome", "microbiota", "skin microbiota", "skin microbiome", "cutaneous microbiome"],
        "category": "mechanism",
        "kr_colloquial": ["마이크로바이옴"],
    },
    "CORAL_TOXICITY": {
        "canonical_en": "coral reef toxicity",
        "aliases": ["coral", "coral reef", "coral bleaching", "coral reefs", "reef safe", "reef-safe"],
        "category": "regulatory",
        "kr_colloquial": [],
    },
    "ENDOCRINE_DISRUPTION": {
        "canonical_en": "endocrine disruption",
        "aliases": ["endocrine disruptor", "endocrine disruptors", "endocrine-disrupting", "edc", "edcs"],
        "category": "regulatory",
        "kr_colloquial": ["내분비계 교란"],
    },
}

#: Labels of whole fields, which say nothing about a paper.
FIELD_LABELS = [
    "agronomy",
    "analytical chemistry",
    "art",
    "biochemistry",
    "biology",
    "biophysics",
    "biotechnology",
    "botany",
    "business",
    "cell biology",
    "chemical engineering",
    "chemistry",
    "computational chemistry",
    "computer science",
    "data science",
    "ecology",
    "economics",
    "engineering",
    "environmental chemistry",
    "environmental engineering",
    "environmental science",
    "epidemiology",
    "food chemistry",
    "food science",
    "genetics",
    "geography",
    "geology",
    "history",
    "horticulture",
    "inorganic chemistry",
    "internal medicine",
    "law",
    "materials science",
    "mathematics",
    "medicine",
    "microbiology",
    "molecular biology",
    "nanoscience",
    "optoelectronics",
    "organic chemistry",
    "pharmacology",
    "philosophy",
    "physical chemistry",
    "physics",
    "political science",
    "psychology",
    "sociology",
    "statistics",
    "toxicology",
    "traditional medicine",
    "veterinary medicine",
    "zoology",
]


def lexicon() -> dict[str, dict]:
    return {key: dict(term) for key, term in TERMS.items()}


def stopwords() -> list[str]:
    return list(FIELD_LABELS)
