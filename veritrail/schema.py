"""The data model: table schemas, vocabularies and accepted values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: vocabularies -----------------------------------------------------------------------------------

ENTITY_LABELS = (
    "Material", "Substance", "ChemicalCompound", "Element", "Ion", "Solution", "Ore", "Concentrate", "Slag", "Matte", "Cathode", "Anode", "Waste",
    "GasStream", "WaterStream", "Product", "ByProduct", "Phase", "GasComponent", "Process", "ProcessStep", "Technology", "Method", "Regime",
    "UnitOperation", "HydrometallurgicalProcess", "PyrometallurgicalProcess", "EnvironmentalProcess", "WasteProcessingProcess",
    "ElectrowinningProcess", "LeachingProcess", "SmeltingProcess", "DesalinationProcess", "GasCleaningProcess", "MineWaterInjectionProcess",
    "Equipment", "Facility", "Cell", "Furnace", "Reactor", "Filter", "MembraneUnit", "Pump", "Pipeline", "GasCleaningSystem",
    "ElectrowinningBath", "FlashSmeltingFurnace", "Parameter", "Property", "Problem", "Expert", "Author", "Team", "Lab", "Organization",
    "Project", "GeoRegion", "Country", "Site", "GeoScope", "TopicTag",
)
FACT_LABELS = (
    "Experiment", "DistributionExperiment", "CaseStudy", "IndustrialPractice", "LabTest", "PilotTest", "FullScaleOperation", "Sample", "Feed",
    "Output", "Condition", "Measurement", "DistributionMeasurement", "Effect", "EfficiencyMetric", "EconomicMetric", "EnvironmentalMetric",
    "Claim", "Conclusion", "Recommendation", "Limitation", "Assumption", "Decision", "Hypothesis", "Contradiction", "Consensus",
    "KnowledgeGap", "ResearchDirection", "Risk", "SimilarCase", "ApplicabilityAssessment",
)
SOURCE_LABELS = ("Document", "DocumentVersion", "Publication", "Page", "Slide", "Chunk", "Table", "TableRow", "Figure", "Formula")
OTHER_LABELS = (
    "EvidencePack", "ValidationRecord", "ClaimVersion", "RelationshipAssertion", "Term", "Alias", "Unit", "Dimension", "ExpertiseScore",
    "GraphPattern", "ClaimGroup", "ConditionDifference", "ExtractionCandidate", "OntologyClass", "OntologyProperty", "ConceptScheme",
)
RELATIONS = (
    "HAS_VERSION", "HAS_PAGE", "HAS_PUBLICATION", "HAS_CHUNK", "HAS_TABLE", "HAS_ROW", "HAS_FIGURE", "HAS_FORMULA", "MENTIONS",
    "EVIDENCED_BY", "HAS_EVIDENCE", "HAS_COMPONENT", "HAS_PHASE", "CONTAINS", "HAS_CONTAMINANT", "HAS_STEP", "USES_MATERIAL", "PRODUCES",
    "USES_EQUIPMENT", "OPERATES_AT", "HAS_REGIME", "APPLIES_TO", "SOLVES", "STUDIES_PROCESS", "USES_FEED", "RUN_ON", "HAS_CONDITION",
    "PRODUCED_MEASUREMENT", "PRODUCED_EFFECT", "PERFORMED_BY", "DESCRIBED_IN", "MEASURES_PROPERTY", "HAS_PARAMETER", "HAS_UNIT",
    "HAS_METHOD", "HAS_SAMPLE", "SUPPORTS", "SUPPORTED_BY", "CONTRADICTS", "GENERALIZES", "HAS_LIMITATION", "BASED_ON", "SUPERSEDED_BY",
    "SUPERSEDES", "VALIDATED_BY", "AUTHOR_OF", "MEMBER_OF", "PART_OF", "EXPERT_IN", "WORKED_ON", "LOCATED_IN", "APPLIED_IN",
    "HAS_GEO_SCOPE", "DESCRIBES_PRACTICE_IN", "MISSING_FOR", "MISSING_PROCESS", "MISSING_PROPERTY", "MISSING_CONDITION",
    "MISSING_GEO_REGION", "DERIVED_FROM", "INVOLVES", "EXPLAINED_BY", "SUMMARIZES", "HAS_TERM", "HAS_ALIAS", "HAS_DIMENSION",
    "CONVERTS_TO", "FROM_PHASE", "TO_PHASE", "FOR_ELEMENT", "HAS_DISTRIBUTION_RESULT", "MEASURES_DISTRIBUTION_OF", "HAS_INPUT_CONDITION",
    "HAS_OUTPUT_TARGET", "HAS_PERFORMANCE", "HAS_ECONOMIC_METRIC", "VALIDATED_BY_CASE", "NEXT_CHUNK", "FIRST_CHUNK", "HAS_ASSERTION",
    "ASSERTS_SOURCE", "ASSERTS_TARGET", "FOR_EXPERT", "IN_TOPIC", "PARTICIPATED_IN", "NEEDS_EXPERT_REVIEW", "SUBCLASS_OF",
)
VALIDATION = ("raw_extracted", "machine_validated", "expert_validated", "rejected", "deprecated", "superseded", "conflicting")
ELEMENT_KINDS = ("text", "table", "table_row", "figure", "formula")
COMPARATORS = ("=", "<", "<=", ">", ">=", "range")

# ---- schemas, as DDL, which readers and createDataFrame take ------------------------------------------------------------------------------------------------------

EVIDENCE = "struct<element_id:string,quote:string,page_number:int,confidence:double>"
_NUMERIC = (
    "local_id:string,name:string,value:double,value_min:double,value_max:double,comparator:string,unit_original:string,method:string,"
    f"material_ref:string,substance_ref:string,evidence:{EVIDENCE},confidence:double,approximate:boolean"
)
_TEXTS = "array<string>"


CORPORA = "id string, display_name string, weight double, description string, enabled boolean, routing_terms array<string>, updated_at timestamp"
PIPELINE_RUNS = "id string, corpus_root string, mode string, deadline_at timestamp, status string, settings map<string,string>, created_at timestamp, updated_at timestamp, finished_at timestamp"
DOCUMENTS = (
    "id string, version_id string, source_locator string, file_name string, file_type string, sha256 string, size_bytes bigint, category string, corpus_id string, title string, "
    "language string, year int, geography array<string>, authors array<string>, metadata map<string,string>, stage string, created_at timestamp, updated_at timestamp"
)
JOBS = (
    "run_id string, document_id string, source_path string, stage string, attempts int, lease_owner string, lease_until timestamp, error string, timings map<string,double>, "
    "extraction_json string, selected_element_ids array<string>, created_at timestamp, updated_at timestamp"
)
CHUNKS = (
    "id string, document_id string, version_id string, corpus_id string, ordinal int, kind string, text string, title string, page_number int, slide_number int, sheet_name string, "
    "row_number int, language string, source_type string, evidence_linked boolean, confidence double, candidate_entities array<struct<name:string,type:string>>, "
    "metadata map<string,string>, embedding array<float>, embedding_model string, embedded_at timestamp, created_at timestamp, updated_at timestamp"
)
NUMERIC_FACTS = "id bigint, chunk_id string, parameter string, value_min double, value_max double, comparator string, unit_original string, unit_normalized string, dimension string, confidence double, metadata map<string,string>"
QUERY_CACHE = "cache_key string, kind string, payload string, created_at timestamp, expires_at timestamp"
AGENT_RUNS = "id string, run_type string, status string, request_json string, state_json string, result_json string, error string, attempts int, cancel_requested boolean, lease_owner string, lease_until timestamp, created_at timestamp, started_at timestamp, updated_at timestamp, finished_at timestamp"
AGENT_EVENTS = "id bigint, run_id string, event_type string, iteration int, payload string, created_at timestamp"
NODES = "id string, labels array<string>, props map<string,string>"
EDGES = "src string, rel string, dst string, props map<string,string>"
ELEMENTS = "id string, kind string, text string, page_number int, slide_number int, sheet_name string, row_number int, bbox array<double>, image_path string, metadata map<string,string>"
EXTRACTION = (
    f"entities array<struct<local_id:string,entity_type:string,canonical_name:string,name_ru:string,name_en:string,aliases:{_TEXTS},description:string,evidence:{EVIDENCE},confidence:double>>, "
    f"conditions array<struct<{_NUMERIC}>>, measurements array<struct<{_NUMERIC},property_name:string>>, "
    f"experiments array<struct<local_id:string,name:string,experiment_type:string,material_refs:{_TEXTS},process_refs:{_TEXTS},equipment_refs:{_TEXTS},condition_refs:{_TEXTS},measurement_refs:{_TEXTS},effect:string,evidence:{EVIDENCE},confidence:double>>, "
    f"claims array<struct<local_id:string,text:string,claim_type:string,entity_refs:{_TEXTS},experiment_refs:{_TEXTS},measurement_refs:{_TEXTS},limitations:{_TEXTS},recommendation:string,geo_scope:string,countries:{_TEXTS},evidence:{EVIDENCE},confidence:double>>, "
    f"experts array<struct<local_id:string,name:string,organization:string,lab:string,topics:{_TEXTS},evidence:{EVIDENCE},confidence:double>>"
)


def unknown_relations(edges: DataFrame) -> DataFrame:
    """Edges whose relation the vocabulary lacks; a writer refuses a batch that has any."""
    return edges.where(~F.col("rel").isin(*RELATIONS))


def bad_vectors(chunks: DataFrame, size: int, vector_col: str = "embedding") -> DataFrame:
    """Chunks whose vector has another length."""
    return chunks.where(F.col(vector_col).isNotNull() & (F.size(vector_col) != size))


def invalid_facts(facts: DataFrame) -> DataFrame:
    """Numeric facts (value, value_min, value_max, comparator) without any value or with an unknown comparator."""
    no_value = F.col("value").isNull() & F.col("value_min").isNull() & F.col("value_max").isNull()
    return facts.where(no_value | F.col("comparator").isNull() | ~F.col("comparator").isin(*COMPARATORS))
