"""Word lists, ontologies, contracts and constants.

Everything in this module is a fixed value: results are only right with exactly these.
"""

from __future__ import annotations

# -- fixed values: tokens and phrases ----------------------------------------------------------------

STOPWORDS = (
    "a an the and or but if then else when while is are was were be been being am to of in on for with as by at from into "
    "that this these those it its i you we they he she them his her our your their do does did doing have has had having"
).split()
NEGATIONS = "no not never none without cannot can't won't don't doesn't didn't".split()
CONSTRAINT_WORDS = (
    "must should shall required require requires only unless except before after until avoid ensure mandatory prohibited "
    "allowed deny approve reject accept include exclude greater less minimum maximum atleast at least not never without cannot"
).split()
CONSTRAINT_PHRASES = ("only if", "at least", "at most", "must not", "should not", "do not", "more than", "less than")
SAFE_PHRASES = (
    "please", "kindly", "basically", "actually", "literally", "just", "really", "i would like to", "i want to", "can you",
    "could you", "would you", "as you know", "in order to", "at the end of the day", "to be honest", "you know", "sort of", "kind of",
)
#: group -> cues looked up in a window padded with spaces, first match wins
CONSTRAINT_GROUPS = (
    ("negation", (" not ", " no ", " never ", " without ", " cannot ", " can't ", " must not ", " should not ", " do not ")),
    ("conditional", (" only if ", " unless ", " provided ", " if ", " when ", " subject to ")),
    ("threshold_min", (" at least ", " minimum ", " min ", ">=", " greater than ", " above ", " more than ")),
    ("threshold_max", (" at most ", " maximum ", " max ", "<=", " less than ", " below ", " no more than ")),
    ("format", (" json ", " schema ", " structured ", " output ", " return ", " format ")),
    ("priority", (" priority ", " prioritize ", " critical ", " important ", " focus ")),
    ("mandatory", (" must ", " required ", " mandatory ", " need ", " needs ", " shall ", " have to ", " has to ", " essential ")),
)
#: group -> substrings that show it survived
GROUP_SYNONYMS = {
    "negation": ("not", "no", "never", "without", "cannot", "can't", "must not", "should not", "do not", "exclude", "avoid"),
    "mandatory": ("must", "required", "mandatory", "need", "needs", "shall", "have to", "has to", "non negotiable", "essential"),
    "conditional": ("if", "only if", "unless", "provided", "when", "where", "condition", "subject to"),
    "threshold_min": ("at least", "minimum", "min", ">=", "greater than", "above", "over", "more than"),
    "threshold_max": ("at most", "maximum", "max", "<=", "less than", "below", "under", "no more than"),
    "priority": ("priority", "prioritize", "critical", "important", "focus", "primary"),
    "format": ("json", "schema", "structured", "return", "output", "format", "strict"),
}
ATOM_WEIGHTS = {"negation": 1.35, "threshold_min": 1.35, "threshold_max": 1.35, "mandatory": 1.2, "conditional": 1.2}
RETENTION_WEIGHTS = {"entity": 0.22, "numeric": 0.20, "constraint": 0.23, "semantic": 0.20, "keyword": 0.15}
INPUT_PRICE, OUTPUT_PRICE = 0.59, 0.79
#: mode -> least retention, duplicate and relevance thresholds
MODES = {"conservative": (0.95, 0.94, 0.12), "balanced": (0.88, 0.90, 0.15), "aggressive": (0.82, 0.86, 0.20)}

# -- fixed values: guarded compression --------------------------------------------------------------

DOMAIN_TERMS = (
    "python", "fastapi", "sql", "rag", "langchain", "milvus", "vector", "database", "databases", "docker", "kubernetes", "ci/cd", "gcp",
    "cloud", "cloud run", "mlops", "watsonx", "llm", "api", "apis", "github", "resume", "jd", "interview", "score", "shortlist", "concern",
    "risk", "weakness", "gap", "production", "deployment", "monitoring", "model registry", "feature store", "drift", "evaluation",
    "human labels", "acceptance metrics", "nokia", "ibm", "groq", "token", "cost", "agent", "agentic", "nlq", "schema", "safety",
)
POLARITY_TERMS = ("no", "not", "never", "without", "avoid", "must not", "do not", "cannot", "lack", "limited", "missing")
CLEANUP_PHRASES = ("please", "kindly", "actually", "basically", "i think", "you know", "to be honest", "in my opinion", "thanks", "thank you", "good morning")
CONTRACT_PREFIXES = (
    "COMPRESSED_CONTEXT_CONTRACT:", "- Preserve all mandatory evidence", "- Concerns/risk evidence", "- Do not infer missing experience",
    "MANDATORY_EVIDENCE_TERMS:", "TASK_TERMS:", "PRESERVED_EVIDENCE:", "MANDATORY_RETAINED_TERMS:",
)
CRITICAL_WORDS = "score|decision|shortlist|concern|risk|weakness|gap|missing|limited|lack|shallow|monitoring|human labels|acceptance metrics|model registry|feature store|kubernetes"
SIGNAL_WORDS = "strength|concern|risk|weakness|gap|required|must|shortlist|decision|score|reason|interview_plan"
TECH_PATTERNS = (
    r"\b(?:Python|FastAPI|SQL|RAG|LangChain|Milvus|Docker|Kubernetes|GCP|Cloud Run|CI/CD|MLOps|Watsonx|IBM|Groq|Llama[-0-9.]*|API|GitHub|NLQ[-–]SQL)\b",
    r"\b\d+(?:\.\d+)?\s*(?:years?|%|lpa|score|tokens?|seconds?|months?)\b",
)
QUALITY_PHRASES = (
    "limited mlops", "lack of", "no production", "human labels", "task-specific", "acceptance metrics", "cloud run", "model registry",
    "feature store", "model drift", "concept drift", "production monitoring", "kubernetes ownership", "shallow mlops",
    "synthetic benchmark data", "synthetic data", "real-world validation logs",
)
PRIORITY_HIGH = ("lack", "limited", "no ", "human labels", "metrics", "mlops", "kubernetes")
PRIORITY_SKILL = ("python", "fastapi", "sql", "rag", "milvus", "docker", "gcp", "cloud")
CONTRACT_LINES = (
    "COMPRESSED_CONTEXT_CONTRACT:",
    "- Preserve all mandatory evidence, negations, constraints, risks, scores, and hiring decision signals.",
    "- Concerns/risk evidence must be retained exactly, not paraphrased away.",
    "- Do not infer missing experience. Do not upgrade weak evidence.",
)
KEYWORD_STOP = (
    "the and for with this that from into about would should could candidate project experience role work using used also have will"
).split()
TOP_TERM_STOP = "the and for with this that from into about would should could candidate".split()

# -- fixed values: evidence ontology ------------------------------------------------------------------

ENTITIES = {
    "python": ("python",),
    "fastapi": ("fastapi", "fast api"),
    "sql": ("sql",),
    "api integration": ("api integration", "apis", "api"),
    "github": ("github", "git hub"),
    "llm": ("llm", "llms", "large language model", "large language models", "llama", "llama-3.3", "llama 3.3"),
    "rag": ("rag", "retrieval augmented generation", "retrieval-augmented generation"),
    "langchain": ("langchain", "lang chain"),
    "milvus": ("milvus", "vector database", "vector databases", "vector db", "vector store"),
    "groq": ("groq",),
    "docker": ("docker", "container", "containerization"),
    "kubernetes": ("kubernetes", "k8s"),
    "gcp": ("gcp", "google cloud", "google cloud platform"),
    "cloud run": ("cloud run", "gcp cloud run"),
    "cloud deployment": ("cloud deployment", "production deployment", "deployment"),
    "ci/cd": ("ci/cd", "cicd", "ci cd", "continuous integration", "continuous deployment", "pipeline"),
    "mlops": ("mlops", "ml ops", "machine learning operations"),
    "model registry": ("model registry", "registry lifecycle", "model lifecycle"),
    "feature store": ("feature store", "feature stores"),
    "model drift": ("model drift", "drift monitoring", "model degradation"),
    "concept drift": ("concept drift", "data drift", "distribution shift"),
    "monitoring": ("monitoring", "observability", "production monitoring", "online monitoring", "runtime monitoring"),
    "human labels": ("human labels", "human evaluation", "human-labeled", "human labelled", "human judgement", "human review"),
    "acceptance metrics": ("acceptance metrics", "task-specific metrics", "quality metrics", "task-specific acceptance metrics", "acceptance criteria"),
    "real-world validation logs": ("real-world validation logs", "real world validation logs", "validation logs", "production validation logs"),
    "resume": ("resume", "cv"),
    "jd": ("jd", "job description"),
    "interview": ("interview", "mock interview", "interview transcript"),
    "score": ("score", "final score", "candidate score"),
    "shortlist": ("shortlist", "shortlisted", "shortlist decision"),
    "cost awareness": ("cost awareness", "token cost", "token optimization", "cost optimization", "cost"),
    "agentic ai": ("agentic", "agentic ai", "agents", "multi-agent"),
    "nlq-sql": ("nlq-sql", "natural language to sql", "nlq sql"),
    "schema grounding": ("schema grounding",),
    "sql safety": ("sql safety", "sql injection prevention"),
}
CONCERNS = {
    "limited deep mlops experience": ("limited deep mlops", "limited mlops", "shallow mlops", "deeper mlops experience", "lack of deep mlops", "weak mlops"),
    "limited kubernetes ownership": ("limited kubernetes", "no production kubernetes", "kubernetes gap", "no production kubernetes ownership", "kubernetes ownership gap", "limited kubernetes ownership"),
    "limited model registry lifecycle": ("model registry", "no model registry", "lack of model registry", "model registry lifecycle", "limited model registry", "registry lifecycle gap"),
    "limited feature store experience": ("feature store", "no feature store", "lack of feature store", "feature stores", "feature store gap"),
    "weak evidence for online monitoring": ("weak evidence for online monitoring", "online monitoring", "production monitoring", "no production monitoring", "observability gap", "weak observability", "limited monitoring"),
    "needs human labels": ("human labels", "human evaluation", "human-labeled", "human labelled", "needs human labels", "requires human labels"),
    "needs task-specific acceptance metrics": ("acceptance metrics", "task-specific acceptance metrics", "task-specific metrics", "needs task-specific acceptance metrics", "acceptance criteria"),
    "model drift validation gap": ("model drift", "drift validation", "model drift monitoring", "model drift gap"),
    "concept drift validation gap": ("concept drift", "concept drift monitoring", "concept drift gap", "data drift"),
    "synthetic benchmark data": ("synthetic data", "synthetic benchmark", "requires real-world validation", "real-world validation logs", "real world validation logs"),
}
REASONS = {
    "python fastapi sql skills": ("python", "fastapi", "sql", "backend"),
    "rag vector database experience": ("rag", "milvus", "vector database", "vector db", "retrieval"),
    "cloud run docker deployment": ("cloud run", "docker", "deployment", "gcp", "cloud deployment"),
    "api integration experience": ("api integration", "api", "fastapi", "apis"),
    "cost awareness and token optimization": ("cost awareness", "token optimization", "token cost", "cost optimization"),
    "honest gap identification": ("honestly identify gaps", "not exaggerate", "do not fabricate", "honest", "gap identification"),
    "mlops governance awareness": ("mlops", "model drift", "concept drift", "monitoring", "acceptance metrics", "human labels"),
}
#: a concern brings its entity along
CONCERN_ENTITY = {
    "needs task-specific acceptance metrics": "acceptance metrics",
    "needs human labels": "human labels",
    "model drift validation gap": "model drift",
    "concept drift validation gap": "concept drift",
}
GOVERNANCE_TERMS = (
    "acceptance metrics", "task-specific acceptance metrics", "human labels", "model drift", "concept drift", "monitoring", "observability",
    "online monitoring", "production monitoring", "real-world validation logs",
)
CONCERN_WEIGHTS = {
    "limited deep mlops experience": 3.0,
    "limited kubernetes ownership": 3.0,
    "limited model registry lifecycle": 2.5,
    "limited feature store experience": 2.5,
    "weak evidence for online monitoring": 3.0,
    "needs human labels": 2.5,
    "needs task-specific acceptance metrics": 3.0,
    "model drift validation gap": 3.0,
    "concept drift validation gap": 3.0,
    "synthetic benchmark data": 0.5,
}
SIMILARITY_STOP = (
    "the a an and or for of to in on with by from this that these those is are was were be been being candidate agent final "
    "score decision shortlist reasons concerns"
).split()
SYNONYMS = {
    "genai": "llm",
    "large language model": "llm",
    "large language models": "llm",
    "retrieval augmented generation": "rag",
    "retrieval-augmented generation": "rag",
    "vector database": "vector db",
    "vector databases": "vector db",
    "observability": "monitoring",
    "online monitoring": "monitoring",
    "production monitoring": "monitoring",
    "evaluation metric": "acceptance metrics",
    "evaluation metrics": "acceptance metrics",
    "task specific acceptance metrics": "acceptance metrics",
    "task-specific acceptance metrics": "acceptance metrics",
    "human label": "human labels",
    "manual labels": "human labels",
    "k8s": "kubernetes",
    "ml ops": "mlops",
    "ci cd": "ci/cd",
}
EVIDENCE_STOP = "the a an for of and or with to in on by needs limited weak".split()
CONSISTENCY_STOP = "the and or a an of in to with for on is are has have may limited".split()

# -- fixed values: memory -------------------------------------------------------------------------------

KNOWN_SKILLS = (
    "python", "fastapi", "django", "flask", "sql", "postgres", "tidb", "mysql", "mongodb", "machine learning", "deep learning", "nlp",
    "computer vision", "llm", "rag", "agents", "agentic", "langchain", "crewai", "milvus", "vector search", "sentence transformers",
    "embeddings", "groq", "watsonx", "openai", "api", "cloud run", "gcp", "docker", "kubernetes", "ci/cd", "mlops", "monitoring",
    "cost optimization", "prompt optimization", "retention scoring", "evaluation", "governance",
)
SENTENCE_CUES = ("must", "required", "mandatory", "experience", "skill", "project", "rag", "llm", "python", "fastapi", "kubernetes", "vector")
CONSTRAINT_CUES = ("must", "required", "mandatory", "should", "only", "unless", "without", "not", "minimum", "maximum", "at least", "json", "schema")

# -- fixed values: output contracts ------------------------------------------------------------------------

#: agent -> ordered (field, type), fields that may not be empty, alias -> field
CONTRACTS = {
    "ResumeIntelligenceAgent": (
        (("skills", "list"), ("years_of_experience", "number"), ("project_evidence", "list"), ("strengths", "list"), ("weak_evidence", "list"), ("missing_evidence", "list"), ("red_flags", "list")),
        ("skills", "project_evidence", "strengths"),
        {"core_skills": "skills", "technical_skills": "skills", "experience_years": "years_of_experience", "projects": "project_evidence", "risks": "red_flags"},
    ),
    "JDRequirementAgent": (
        (("must_have_requirements", "list"), ("good_to_have_skills", "list"), ("domain_expectations", "list"), ("screening_constraints", "list"), ("scoring_weights", "dict")),
        ("must_have_requirements", "screening_constraints"),
        {"mandatory_requirements": "must_have_requirements", "mandatory_skills": "must_have_requirements", "required_skills": "must_have_requirements", "preferred_requirements": "good_to_have_skills", "preferred_skills": "good_to_have_skills", "constraints": "screening_constraints", "weights": "scoring_weights"},
    ),
    "SemanticFitScoringAgent": (
        (("fit_score", "score_100"), ("matched_skills", "list"), ("partial_matches", "list"), ("missing_skills", "list"), ("evidence_strength", "string"), ("rejection_risks", "list"), ("scoring_rationale", "list")),
        ("matched_skills", "scoring_rationale", "evidence_strength"),
        {"score": "fit_score", "role_fit_score": "fit_score", "risks": "rejection_risks", "rationale": "scoring_rationale", "reasoning": "scoring_rationale"},
    ),
    "SkillGapReadinessAgent": (
        (("priority_gaps", "list"), ("week_by_week_plan", "list"), ("project_improvements", "list"), ("resume_fixes", "list"), ("interview_readiness_actions", "list")),
        ("priority_gaps", "week_by_week_plan", "interview_readiness_actions"),
        {"skill_gaps": "priority_gaps", "weekly_plan": "week_by_week_plan", "plan": "week_by_week_plan", "resume_improvements": "resume_fixes", "interview_actions": "interview_readiness_actions"},
    ),
    "InterviewQuestionAgent": (
        (("technical_questions", "list"), ("project_deep_dive_questions", "list"), ("system_design_questions", "list"), ("ml_fundamentals_questions", "list"), ("behavioral_questions", "list"), ("recruiter_screening_questions", "list")),
        ("technical_questions", "project_deep_dive_questions", "system_design_questions", "ml_fundamentals_questions", "behavioral_questions", "recruiter_screening_questions"),
        {"technical": "technical_questions", "technical_question": "technical_questions", "project_deep_dive": "project_deep_dive_questions", "project_questions": "project_deep_dive_questions", "system_design": "system_design_questions", "ml_fundamentals": "ml_fundamentals_questions", "machine_learning_questions": "ml_fundamentals_questions", "behavioral": "behavioral_questions", "recruiter_screening": "recruiter_screening_questions"},
    ),
    "RecruiterDecisionAgent": (
        (("shortlist_decision", "enum_shortlist"), ("hireability_label", "enum_hireability"), ("risks", "list"), ("reasons", "list"), ("interview_focus_areas", "list"), ("next_step", "enum_next_step"), ("fit_score", "score_100"), ("missing_evidence", "list")),
        ("shortlist_decision", "hireability_label", "reasons", "interview_focus_areas", "next_step"),
        {"decision": "shortlist_decision", "recommendation": "shortlist_decision", "hireability": "hireability_label", "focus_areas": "interview_focus_areas", "next_action": "next_step", "score": "fit_score"},
    ),
}
#: field -> ordered (canonical, variants), and the default
ENUMS = {
    "shortlist_decision": (
        (("SHORTLIST", ("shortlist", "yes", "recommend", "recommended", "strong yes", "pass")), ("REJECT", ("reject", "no", "do not shortlist", "not recommended", "fail")), ("HOLD", ("hold", "maybe", "borderline", "needs review", "manual review"))),
        "HOLD",
    ),
    "hireability_label": (
        (("HIGHLY_HIREABLE", ("highly hireable", "very strong", "excellent", "strong hire", "high")), ("STRONG", ("strong", "good", "hireable", "recommended")), ("MODERATE", ("moderate", "average", "medium", "borderline")), ("WEAK", ("weak", "low", "not hireable", "poor"))),
        "MODERATE",
    ),
    "next_step": (
        (("SCHEDULE_TECHNICAL_INTERVIEW", ("schedule interview", "schedule technical interview", "technical interview", "interview")), ("REQUEST_MORE_EVIDENCE", ("request more evidence", "ask for evidence", "need evidence")), ("REJECT_CANDIDATE", ("reject", "reject candidate", "no next step")), ("MANUAL_REVIEW", ("manual review", "review", "needs review"))),
        "MANUAL_REVIEW",
    ),
}
#: contract field type -> enum
ENUM_TYPES = {"enum_shortlist": "shortlist_decision", "enum_hireability": "hireability_label", "enum_next_step": "next_step"}
#: what a prompt says about a contract: lines before and after its fields
CONTRACT_OPEN = ("OUTPUT CONTRACT - return valid JSON only; no markdown; no prose outside JSON.", "Required fields and types:")
CONTRACT_CLOSE = (
    "Do not omit required fields. Use [] only when evidence is genuinely absent and the field is not marked non-empty.",
    "Use stable field names exactly as listed above.",
)
REPAIR_OPEN = (
    "Repair the following model output so it satisfies the output contract exactly. Preserve the original meaning. Do not add unsupported facts. "
    "If a field is required but evidence is missing, use a short evidence-missing placeholder only when the field is non-empty; otherwise use []."
)
REPAIR_CLOSE = "\n\nMODEL_OUTPUT_TO_REPAIR:\n"
#: final-decision responses: shorter names a model may use, list fields, patterns of a score and a decision in prose
RESPONSE_NAMES = {"score": "final_score", "decision": "shortlist_decision", "evidence": "evidence_terms", "questions": "interview_plan", "risks": "concerns"}
RESPONSE_LISTS = ("evidence_terms", "reasons", "concerns", "interview_plan")
RESPONSE_SCORES = (r"final[_ ]?score\s*[\":=]+\s*([0-9]+(?:\.[0-9]+)?)", r"score\s*[\":=]+\s*([0-9]+(?:\.[0-9]+)?)", r"([0-9]+(?:\.[0-9]+)?)\s*/\s*10")
RESPONSE_DECISIONS = (r"shortlist_decision\s*[\":=]+\s*['\"]?([A-Za-z _-]+)", r"decision\s*[\":=]+\s*['\"]?([A-Za-z _-]+)", r"\b(Shortlist|Reject|Hold)\b")
NULL_WORDS = ("none", "n/a", "na", "not applicable", "no", "nil", "[]")
#: agent -> mode, least retention, input tokens, output tokens; all are schema strict and may retry once
POLICIES = {
    "ResumeIntelligenceAgent": ("balanced", 0.86, 3200, 420),
    "JDRequirementAgent": ("balanced", 0.86, 3000, 380),
    "SemanticFitScoringAgent": ("conservative", 0.90, 3000, 420),
    "SkillGapReadinessAgent": ("balanced", 0.86, 2800, 500),
    "InterviewQuestionAgent": ("aggressive", 0.82, 2400, 520),
    "RecruiterDecisionAgent": ("conservative", 0.90, 2800, 420),
}

# -- fixed values: columns of a call record, in the order of its report ------------------------------

CALL_COLUMNS = (
    ("agent_name", "string"), ("status", "string"), ("agent_mode", "string"), ("risk_label", "string"), ("pacer_sleep_seconds", "double"),
    ("estimated_total_tokens_for_pacing", "bigint"), ("estimated_prompt_tokens_sent", "bigint"), ("actual_prompt_tokens", "bigint"),
    ("actual_completion_tokens", "bigint"), ("actual_total_tokens", "bigint"), ("prompt_token_estimation_error_pct", "double"),
    ("actual_cost_usd", "double"), ("reconciled_savings_usd", "double"), ("original_tokens", "bigint"), ("optimized_tokens", "bigint"),
    ("tokens_saved", "bigint"), ("reduction_percentage", "double"), ("retention_score", "double"), ("entity_retention", "double"),
    ("numeric_retention", "double"), ("constraint_retention", "double"), ("semantic_similarity", "double"), ("keyword_coverage", "double"),
    ("optimizer_status", "string"), ("optimizer_reason", "string"), ("schema_valid", "boolean"), ("schema_repaired", "boolean"),
    ("schema_errors", "array<string>"), ("schema_warnings", "array<string>"), ("schema_repair_actions", "array<string>"),
    ("schema_quality_score", "double"), ("schema_retry_attempted", "boolean"), ("schema_retry_success", "boolean"),
    ("schema_retry_tokens", "bigint"), ("schema_retry_cost_usd", "double"), ("evidence_consistent", "boolean"),
    ("evidence_consistency_score", "double"), ("evidence_warnings", "array<string>"), ("error", "string"),
)
