"""Fixed values.

Word lists, patterns, lookup tables and default parameters that must have exactly these values
for results to agree with published numbers. Nothing here is logic.
"""

# Stop words removed by the lexical tokeniser.
STOP_WORDS = (
    "a", "o", "as", "os", "um", "uma", "uns", "umas",
    "de", "da", "do", "das", "dos", "em", "no", "na", "nos", "nas",
    "por", "para", "com", "sem", "sob", "sobre", "ante", "perante",
    "e", "ou", "mas", "porém", "se", "que", "como", "quando",
    "é", "são", "foi", "será", "ser", "estar", "ter", "haver",
    "este", "esta", "isto", "esse", "essa", "isso", "aquele",
    "aquela", "aquilo", "seu", "sua", "seus", "suas",
    "ao", "à", "aos", "às",
)

# Phrases by which an answer declines in its text (matched without case).
REFUSAL_PATTERN = (
    "não é possível responder|nao e possivel responder|não posso responder"
    "|contexto (?:fornecido )?(?:é|e) insuficiente|não há informa|nao ha informa"
    "|material fornecido não|não contém informa|não permite responder"
)

# Field names tried, in this order, by the corpus reader.
ID_FIELDS = ("id", "numero_acordao", "number", "filename", "doc_id", "key", "acórdão")
TEXT_FIELDS = ("text", "texto", "ementa", "content", "conteudo", "filedata", "body", "decision")
NESTED_TEXT_FIELDS = ("text", "content", "texto", "titulo", "ementa")
REFERENCE_FIELDS = (
    "all_formatted_references",
    "formatted_references",
    "embedded_references",
    "references",
)

# Words that mark a reference as a ruling.
RULING_MARKS = ("carf", "acórdão", "acordao")

# Id prefixes of documents built from an item's own references.
PROVISION_PREFIX = "disp_"
RULING_PREFIX = "carf_"
RULING_NAME_PATTERN = r"^\d[\d_]*(\.txt)?$"

# Verdict codes and their labels.
SUFFICIENCY_LABELS = {2: "suficiente", 1: "parcial", 0: "insuficiente"}
REFUSAL_LABELS = {2: "justificada", 1: "evasiva", 0: "nao-recusa", -1: "falha"}

# Labels of the retrieval strata, in report order.
RETRIEVAL_STRATA = ("sem_doc_ref", "recall=0", "0<recall<0.5", "recall>=0.5")

# Default parameters.
CHUNK_MAX_TOKENS = 512
CHUNK_OVERLAP_TOKENS = 64
PARAGRAPH_SEPARATOR = "\n\n"
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
POOL_PER_BRANCH = 50
RERANK_POOL = 100
N_FINAL = 7
QUOTAS = {"norm": 5, "ruling": 2}
SHARED_RUN_WORDS = 15
ECE_BINS = 15
CURVE_POINTS = 200
N_FOLDS = 10
N_VAL_FOLDS = 2
GOLDEN_TOLERANCE = 0.001

# Retrieval sweep, as (dense k, lexical k, chunks per document).
SWEEP_SETTINGS = (
    (5, 5, 1),
    (5, 5, 3),
    (5, 5, 99),
    (15, 15, 1),
    (15, 15, 3),
    (30, 30, 1),
    (30, 30, 3),
    (50, 50, 99),
    (30, 1, 3),
    (1, 30, 3),
)

# Texts of the rendered context.
CONTEXT_HEADER = "[DOCUMENTO %d — %s]"
EMPTY_CONTEXT = "(Nenhum documento recuperado para esta pergunta.)"
MISSING_CHUNK = "(chunk não encontrado no índice)"

# Coverages of the decision audit, variants contrasted (first minus second), and the ratio
# metrics with the contrasts that report them (of variants, of stored points).
AUDIT_COVERAGES = (0.3, 0.5, 0.7, 0.9, 1.0)
CONTRAST_PAIRS = (("A5", "A7"), ("A4", "A1"), ("A5", "A0"), ("A5", "B0"))
METRIC_CONTRASTS = {
    "nominal_coverage": ("points",),
    "effective_coverage": ("variants", "points"),
    "conventional_risk": ("points",),
    "substantive_risk": ("variants", "points"),
    "abstention_error_precision": ("points",),
    "abstention_error_recall": ("points",),
    "false_abstention_rate": ("points",),
    "abstention_context_precision_strict": (),
    "abstention_context_precision_broad": (),
    "nonresponse_context_precision_strict": (),
    "nonresponse_context_precision_broad": (),
    "abstention_given_insufficient": (),
    "abstention_given_partial": (),
    "abstention_given_sufficient": (),
    "conventional_utility": ("variants", "points"),
    "effective_error_utility": ("variants", "points"),
    "context_utility_strict": ("variants", "points"),
    "context_utility_broad": ("variants", "points"),
    "context_penalty_strict": ("variants", "points"),
    "context_penalty_broad": ("variants", "points"),
}
