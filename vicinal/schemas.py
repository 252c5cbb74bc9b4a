"""Schemas of the data model. Ids are longs, timestamps have no zone, vectors are arrays of float."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType())}


def _of(columns: str) -> T.StructType:
    """Columns as name and type; schemas exist before any session does."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


QUERY_MATRIX = _of("query_cell_id string, total_mrna_umis float, x array<float>")
QUERY_MATRIX_SPARSE = _of("query_cell_id string, feature_index int, value float")
EMBEDDING_BATCH = _of("query_cell_id string, embedding array<float>")
NEIGHBOURS = _of("query_cell_id string, rank bigint, cas_cell_index bigint, distance double")
VECTOR_INDEX = _of("id bigint, embedding array<float>, partition_id int, ts timestamp_ntz")
CENTROIDS = _of("partition_id int, centroid array<double>")
FEATURES = _of("index int, feature_name string")
TERMS = _of("ord int, term string, name string")
EDGES = _of("parent string, child string")
CLOSURE = _of("term string, ancestor string")

INGESTS = _of("cas_ingest_id string, dataset_id string, dataset_version_id string, uns_metadata string, ingest_timestamp timestamp_ntz")
FEATURE_INFO = _of(
    "cas_feature_index int, original_feature_id string, feature_name string, feature_biotype string, feature_is_filtered boolean, feature_reference string, var_metadata_extra string, cas_ingest_id string"
)
CELLS = _of(
    "cas_cell_index bigint, cas_ingest_id string, original_cell_id string, obs_metadata_extra string, is_primary_data boolean, donor_id string, cell_type string, assay string, development_stage string, tissue string, disease string, organism string, self_reported_ethnicity string, sex string, suspension_type string, total_mrna_umis int, cell_type_ontology_term_id string, assay_ontology_term_id string, development_stage_ontology_term_id string, tissue_ontology_term_id string, disease_ontology_term_id string, organism_ontology_term_id string, self_reported_ethnicity_ontology_term_id string, sex_ontology_term_id string"
)
METADATA_SOURCES = _of("id bigint, name string, soma_dataframe_uri string, created_date timestamp_ntz")
ONTOLOGY_COLUMNS = _of("id bigint, cell_info_metadata_id bigint, ontology_resource_name string, column_name string, ontology_resource_uri string, description string")
MODELS = _of("id bigint, model_name string, model_file_path string, description string, embedding_dimension int, admin_use_only boolean, schema_name string, bq_dataset_name string, is_default_model boolean, cell_info_metadata_id bigint, created_date timestamp_ntz")
LEGACY_INDEXES = _of("id bigint, index_name string, description string, embedding_dimension int, endpoint_id string, deployed_index_id string, num_neighbors int, model_id bigint, is_grpc boolean, api_endpoint string")
INDEXES = _of("id bigint, index_name string, description string, embedding_dimension int, num_neighbors int, index_uri string, index_type string, distance_metric string, nprobe int, l_search int, memory_budget bigint, model_id bigint")
USERS = _of("id bigint, email string, username string, active boolean, requests_processed bigint, cells_processed bigint, is_admin boolean, cell_quota bigint, lifetime_cell_quota bigint, quota_increased boolean, created_at timestamp_ntz, ask_for_feedback boolean")
ACTIVITY = _of("id bigint, user_id bigint, request_id string, cell_count bigint, model_name string, method string, finished_time timestamp_ntz, event string")
USER_KEYS = _of("id bigint, key_locator string, user_id bigint, created_date timestamp_ntz, active boolean, expires timestamp_ntz, key_hash string")
#: Values that ACTIVITY.event takes.
EVENTS = ("SUCCEEDED", "FAILED", "STARTED")


def embedding_file(dimension: int) -> T.StructType:
    """A batch file without a header: an id and the components."""
    return T.StructType([T.StructField("_c0", T.LongType()), *(T.StructField(f"_c{i}", T.FloatType()) for i in range(1, dimension + 1))])
