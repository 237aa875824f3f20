"""Constants that decide results and therefore must not drift.

Everything in this module is data. The operators read it as default
arguments, so every table here can be replaced by the caller.
"""

# Merchant segments, in index order (one-hot position 0, 1, 2).
SEGMENTS = ("MEI", "VAREJO", "CORPORATE")
DEFAULT_SEGMENT = "VAREJO"

# Winner text -> class index.
LABELS = {"model_a": 0, "model_b": 1, "tie": 2, "tie (bothbad)": 2}
NUM_CLASSES = 3

# Class index -> winner name used by scores and feedback.
WINNERS = ("A", "B", "tie")

# Winner name of a feedback event -> winner text of a training row.
FEEDBACK_TO_TRAINING = {"A": "model_a", "B": "model_b", "tie": "tie"}

# Main redaction dialect (type, pattern, placeholder); order matters.
PII_MAIN = (
    ("cpf", r"\b\d{3}[.\-]?\d{3}[.\-]?\d{3}[-]?\d{2}\b", "[CPF_REDACTED]"),
    ("cnpj", r"\b\d{2}[.\-]?\d{3}[.\-]?\d{3}[/]?\d{4}[-]?\d{2}\b", "[CNPJ_REDACTED]"),
    ("card", r"\b(?:\d[ -]?){13,19}\b", "[CARD_REDACTED]"),
    ("phone", r"\(?\d{2}\)?[\s\-]?9\d{4}[\s\-]?\d{4}\b", "[PHONE_REDACTED]"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
)

# Portuguese redaction dialect (type, pattern, placeholder); order matters.
PII_PORTUGUESE = (
    ("cpf", r"(\d{3}\.?\d{3}\.?\d{3}-?\d{2})", "[CPF_REMOVIDO]"),
    ("card", r"(\b(?:\d[ -]?){13,19}\b)", "[CARTAO_REMOVIDO]"),
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL_REMOVIDO]"),
    ("phone", r"(\(?\d{2}\)?\s?\d{4,5}-?\d{4})", "[TELEFONE_REMOVIDO]"),
)

# Control characters removed by text clean-up (tab, LF and CR stay).
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# Keyword -> intent, first contained keyword wins.
INTENT_RULES = (
    ("taxa", "reclamacao_taxa"),
    ("caro", "reclamacao_taxa"),
    ("mdr", "duvida_taxa_mdr"),
    ("parcel", "duvida_parcelamento"),
    ("maquininha", "problema_terminal"),
    ("terminal", "problema_terminal"),
    ("cancelar", "cancelamento"),
    ("cancelamento", "cancelamento"),
)
DEFAULT_INTENT = "outros"

# Tone of an answer by segment.
SEGMENT_TONES = {
    "MEI": "simples, direto e acolhedor",
    "VAREJO": "consultivo e profissional",
    "CORPORATE": "técnico, executivo e preciso",
}
DEFAULT_TONE = "profissional"

# Hint given to the generator by intent.
ACTION_HINTS = {
    "reclamacao_taxa": "ofereça uma simulação de antecipação de recebíveis",
    "duvida_taxa_mdr": "explique detalhadamente a composição do MDR",
    "duvida_parcelamento": "explique os prazos de recebimento e taxas de parcelamento",
    "problema_terminal": "abra um chamado técnico e forneça ETA de resolução",
    "cancelamento": "ative o script de retenção, destaque benefícios exclusivos",
    "outros": "direcione ao atendimento geral com empatia",
}
DEFAULT_ACTION_HINT = "responda com empatia"

# Reasoning prompt; {company} is the caller's brand.
REASONING_PROMPT = (
    "<|system|>\n"
    "Você é o assistente de suporte da {company}. "
    "Responda em português, com tom {tone}. "
    "Segmento do lojista: {segment}.\n"
    "<|user|>\n"
    "{message}\n"
    "<|assistant|>\n"
    "<think>\n"
    "Vou analisar a mensagem do lojista passo a passo:\n"
    "1. Intent detectado: {intent}\n"
    "2. Segmento: {segment} — tom adequado: {tone}\n"
    "3. Ação recomendada pelo roteador: {action}\n"
    "4. Devo ser empático, resolver o problema e {action}.\n"
    "</think>\n"
)
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

# Intent -> (support action, priority, description).
INTENT_ACTIONS = (
    ("reclamacao_taxa", "antecipacao", 1,
     "Lojista reclama de taxa alta → oferecer antecipação de recebíveis"),
    ("duvida_taxa_mdr", "info_taxa_mdr", 2, "Dúvida sobre MDR → explicar composição da taxa"),
    ("duvida_parcelamento", "info_parcelamento", 2,
     "Dúvida sobre parcelamento → explicar regras e prazos"),
    ("solicitacao_aumento_parcelamento", "avaliacao_credito", 1,
     "Solicitar mais parcelas → iniciar avaliação de crédito"),
    ("problema_terminal", "suporte_tecnico", 1, "Problema com maquininha → abrir chamado técnico"),
    ("solicitacao_novo_terminal", "proposta_equipamento", 2, None),
    ("cancelamento", "retencao_avancada", 0, "Sinal de churn → ativar script de retenção"),
    ("outros", "atendimento_geral", 3, None),
)

# Segment -> (confidence threshold, answer token limit, human review).
SEGMENT_POLICY = (
    ("MEI", 0.70, 256, False),
    ("VAREJO", 0.75, 384, False),
    ("CORPORATE", 0.85, 512, True),
)

# Contract limits of requests, batches and feedback events.
MAX_TEXT_CHARS = 4096
MAX_ID_CHARS = 128
MAX_BATCH_ITEMS = 32
FEEDBACK_CHANNELS = ("webchat", "api", "whatsapp", "mobile")
DEFAULT_CHANNEL = "api"
SATISFACTION_RANGE = (1, 5)
PROBABILITY_SUM_TOLERANCE = 1e-4

# Text cuts (submission prediction, audit record, audit console).
SUBMISSION_CHARS = 500
AUDIT_CHARS = 200
AUDIT_DISPLAY_CHARS = 100
THINKING_DISPLAY_CHARS = 300
RESPONSE_DISPLAY_CHARS = 400
AUDIT_EXTENSIONS = (".log", ".json", ".txt", ".csv")

# Encoding and scoring defaults.
MAX_TOKENS = 1024
RESERVED_TOKENS = 10
CACHE_TTL_SECONDS = 3600
AUX_DIM = 12

# Loss and training defaults.
LABEL_SMOOTHING = 0.1
RANKING_MARGIN = 0.1
CLASSIFICATION_WEIGHT = 0.7
EPOCHS = 3
WARMUP_SHARE = 0.1
WEIGHT_DECAY = 0.01
PATIENCE = 2
KEEP_CHECKPOINTS = 2

# Upper bounds of the latency histograms, in seconds.
REQUEST_LATENCY_BOUNDS = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)
INFERENCE_LATENCY_BOUNDS = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0, 5.0)

# Latency targets in milliseconds by percentile, and the per-row limit.
LATENCY_TARGETS_MS = ((0.50, 100.0), (0.95, 200.0), (0.99, 300.0))
LATENCY_LIMIT_MS = 300.0

# Acceptance gates (metric, comparison, threshold, severity when violated).
EVALUATION_GATE = (("auc", "min", 0.70, "fail"), ("ece", "below", 0.05, "warn"))
STRICT_GATE = (
    ("auc", "min", 0.80, "fail"),
    ("accuracy", "min", 0.75, "fail"),
    ("ece", "max", 0.05, "fail"),
)

# Drift, retention and imbalance thresholds.
PSI_THRESHOLD = 0.2
RETENTION_DAYS = 90
IMBALANCE_SHARE = 0.10

# Alert rules (name, metric, threshold, severity, action); fires when value > threshold.
ALERT_RULES = (
    ("p99_breach", "latency_p99_ms", 300.0, "critical", "page_oncall"),
    ("psi_drift", "psi", 0.2, "warning", "trigger_retrain_pipeline"),
    ("pii_leak", "pii_scrubbed_cpf", 0.0, "critical", "block_and_audit"),
)
