"""Fixed schemas.  Nothing in the package infers a schema."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _KINDS[kind]))
    return T.StructType(fields)


_KINDS = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "labels": T.MapType(T.StringType(), T.StringType()),
}

# One record of the event stream, as a Kafka source delivers it.
RAW_EVENT = _struct(
    "key string,value string,topic string,partition int,offset long,timestamp timestamp"
)

# The JSON body of an event.  Optional fields are NULL when absent or empty.
EVENT_FIELDS = ["tenant_id", "timestamp", "level", "service", "message", "trace_id", "ip"]
REQUIRED_FIELDS = ["timestamp", "level", "service", "message"]

# A stored document: the event, its arrival, and what is derived from both.
DOCUMENT = _struct(
    "tenant_id string,timestamp string,level string,service string,message string,"
    "trace_id string,ip string,ingested_at timestamp,event_ts timestamp,doc_id string,"
    "partition int,offset long,event_date date"
)

DLQ = _struct("key string,original_message string,error string,failed_at string,processor_id string")

INDEX_INFO = _struct(
    "name string,doc_count long,store_size_bytes long,creation_date timestamp,status string"
)

TENANTS = _struct(
    "id string,name string,slug string,status string,created_at timestamp,updated_at timestamp"
)
API_KEYS = _struct(
    "id string,tenant_id string,key_hash string,name string,status string,"
    "created_at timestamp,last_used_at timestamp,expires_at timestamp"
)
SERVICES = _struct(
    "id string,tenant_id string,name string,created_at timestamp,updated_at timestamp"
)
RETENTION_POLICIES = _struct(
    "id string,tenant_id string,retention_days int,enabled boolean,"
    "created_at timestamp,updated_at timestamp"
)
APPLICATIONS = _struct("id string,name string,description string,created_at timestamp")
ENVIRONMENTS = _struct("id string,name string,created_at timestamp")
APP_SERVICES = _struct(
    "id string,application_id string,environment_id string,name string,"
    "description string,created_at timestamp"
)
ALERT_RULES = _struct(
    "id string,service_id string,name string,condition string,threshold int,"
    "window_minutes int,enabled boolean,created_at timestamp,updated_at timestamp"
)
SAVED_SEARCHES = _struct("id string,name string,query string,created_at timestamp")

METADATA_TABLES = {
    "tenants": TENANTS,
    "api_keys": API_KEYS,
    "services": SERVICES,
    "retention_policies": RETENTION_POLICIES,
    "applications": APPLICATIONS,
    "environments": ENVIRONMENTS,
    "app_services": APP_SERVICES,
    "alert_rules": ALERT_RULES,
    "saved_searches": SAVED_SEARCHES,
}

REQUEST_SAMPLE = _struct("ts timestamp,latency_ns long,status_code int,failed boolean")
SAMPLE = _struct("ts timestamp,metric string,labels labels,le double,value double")
