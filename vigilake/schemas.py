"""Schemas of the event model, as DDL."""

TRACKED = (
    "struct<class_name:string,class_id:int,confidence:double,x1:double,y1:double,x2:double,y2:double,"
    "track_id:int,track_state:int,occluded:boolean>"
)
#: Track states by number.
TRACK_STATES = ("NEW", "MATCHED", "LOST", "DEAD")
INGRESS = "ingress_id string, event string"
JOB = (
    "job_id bigint, kind string, entity_id string, entity_revision int, state string, attempts int, lease_owner string, "
    "lease_expires_ms bigint, available_at_ms bigint, last_error string"
)
#: The JSON object on the wire; `class` and `class_name`, `pts` and `source_pts`, `generation` and `stream_generation`
#: are two names of one field each.
WIRE = (
    "event_id string, type string, event_type string, source string, timestamp_ms bigint, frame_id bigint, "
    "generation bigint, stream_generation bigint, pts bigint, source_pts bigint, severity string, rule_id string, "
    "rule_version string, rule_facts map<string,string>, "
    "detections array<struct<class:string,class_name:string,class_id:int,confidence:double,bbox:array<double>,"
    "track_id:int,track_state:string,occluded:boolean>>, "
    "evidence array<struct<kind:string,path:string,available:boolean,size:bigint,mtime:double,sha256:string>>"
)
