"""Explicit types of snapshot documents; nothing is inferred."""

from __future__ import annotations

COLUMN = "struct<name:string,ordinal:smallint,type_name:string,nullable:boolean,`default`:string,identity:string,generated:string,comment:string,statistics_target:int>"
CONSTRAINT = "struct<name:string,kind:string,columns:array<string>,definition:string,fk_table:string,fk_columns:array<string>,backing_index:string,comment:string>"
INDEX = "struct<name:string,columns:array<string>,include_columns:array<string>,index_type:string,is_unique:boolean,is_primary:boolean,predicate:string,definition:string,is_valid:boolean,backs_constraint:boolean>"
PARTITIONS = "struct<strategy:string,key:string,children:array<struct<schema:string,name:string,bound:string>>>"
POLICY = "struct<name:string,command:string,permissive:boolean,roles:array<string>,using_expr:string,with_check_expr:string>"
TABLE = (
    f"struct<oid:bigint,schema:string,name:string,columns:array<{COLUMN}>,constraints:array<{CONSTRAINT}>,indexes:array<{INDEX}>,comment:string,"
    f"partition_info:{PARTITIONS},policies:array<{POLICY}>,triggers:array<struct<name:string,definition:string>>,reloptions:array<string>,rls_enabled:boolean>"
)
SNAPSHOT = (
    f"project_id string, database_id string, version string, database string, timestamp timestamp, content_hash string, tables array<{TABLE}>, "
    "enums array<struct<schema:string,name:string,labels:array<string>>>, "
    "domains array<struct<schema:string,name:string,base_type:string,checks:array<string>>>, "
    "composites array<struct<schema:string,name:string,fields:array<struct<name:string,type_name:string>>>>, "
    "views array<struct<schema:string,name:string,definition:string,is_materialized:boolean,comment:string>>, "
    "functions array<struct<schema:string,name:string,identity_args:string,return_type:string,volatility:string,security_definer:boolean>>, "
    "extensions array<struct<name:string,version:string>>, settings array<struct<name:string,setting:string,unit:string>>"
)
SIZING = "schema:string,name:string,reltuples:double,relpages:bigint"
PLANNER = (
    f"project_id string, database_id string, schema_ref_hash string, timestamp timestamp, tables array<struct<{SIZING},table_size:bigint>>, indexes array<struct<{SIZING},size:bigint>>, "
    "columns array<struct<schema:string,table:string,name:string,null_frac:double,n_distinct:double,most_common_vals:string,most_common_freqs:string,histogram_bounds:string,correlation:double>>"
)
COUNTERS = (
    "schema:string,name:string,seq_scan:bigint,idx_scan:bigint,n_live_tup:bigint,n_dead_tup:bigint,last_vacuum:timestamp,last_autovacuum:timestamp,last_analyze:timestamp,"
    "last_autoanalyze:timestamp,vacuum_count:bigint,autovacuum_count:bigint,analyze_count:bigint,autoanalyze_count:bigint"
)
ACTIVITY = (
    "project_id string, database_id string, schema_ref_hash string, timestamp timestamp, content_hash string, "
    "node struct<label:string,host:string,is_standby:boolean,replication_lag_bytes:bigint,stats_reset:timestamp>, "
    f"tables array<struct<{COUNTERS}>>, indexes array<struct<schema:string,name:string,idx_scan:bigint,idx_tup_read:bigint,idx_tup_fetch:bigint>>"
)
CAPTURE = "project_id string, database_id string, kind string, node_label string, content_hash string, captured_at timestamp, payload string"
