"""Fixed values. They have to equal the monitored platform's own names and the
published rules, so they are stated here together, plainly, and used everywhere else by name."""

# -- fixed values: activity columns -------------------------------------------------
ACTIVITY_RENAMES = {
    "Id": "event_id",
    "ActivityId": "activity_id",
    "Activity": "activity_type",
    "ItemId": "item_id",
    "ItemName": "item_name",
    "ItemType": "item_type",
    "WorkspaceId": "workspace_id",
    "WorkspaceName": "workspace_name",
    "_workspace_name": "workspace_name",
    "_workspace_id": "workspace_id",
    "SubmittedBy": "submitted_by",
    "CreatedBy": "created_by",
    "LastUpdatedBy": "last_updated_by",
    "Domain": "domain",
    "Location": "location",
    "ObjectUrl": "object_url",
    "Status": "status",
    "DurationSeconds": "duration_seconds",
    "CreationTime": "creation_time",
    "StartTime": "start_time",
    "EndTime": "end_time",
    "CompletionTime": "completion_time",
}

REQUIRED_ACTIVITY_COLUMNS = [
    "event_id", "activity_id", "activity_type", "item_id", "item_name", "item_type",
    "workspace_id", "workspace_name", "submitted_by", "created_by", "last_updated_by",
    "domain", "location", "object_url", "status", "start_time", "end_time", "duration_seconds",
]

RAW_EVENT_COLUMNS = [
    "Id", "Activity", "ActivityId", "ItemName", "ItemType", "ItemId", "WorkspaceId",
    "WorkspaceName", "UserId", "UserKey", "SubmittedBy", "CreatedBy", "LastUpdatedBy",
    "CreationTime", "StartTime", "EndTime", "CompletionTime", "Status", "Duration",
    "DurationMs", "DurationSeconds", "RecordType", "UserType", "UserAgent", "ClientIP",
    "ObjectUrl", "Domain", "Location", "_workspace_id", "_workspace_name", "_extraction_date",
]

RAW_EVENT_ALTERNATES = {
    "Activity": ["ActivityName", "Operation"],
    "ItemName": ["ReportName", "DatasetName", "DashboardName"],
    "WorkspaceId": ["GroupId"],
    "WorkspaceName": ["GroupName"],
    "UserId": ["UserPrincipalName", "User"],
    "CreationTime": ["ActivityDateTime", "EventDateTime", "Timestamp"],
    "StartTime": ["ActivityDateTime"],
    "EndTime": ["CompletionTime"],
    "Duration": ["DurationMs", "ExecutionTime"],
}

ITEM_ID_KEYS = ["ItemId", "ArtifactId", "ObjectId", "ArtifactInstanceId", "DatasetId", "ReportId"]
ITEM_NAME_KEYS = ["ArtifactName", "ObjectName", "Name", "DatasetName", "ReportName"]
ITEM_TYPE_KEYS = ["ArtifactType", "ArtifactKind", "ObjectType"]

MASTER_COLUMNS = [
    "event_id", "activity_id", "workspace_id", "workspace_name", "item_id", "item_name",
    "item_type", "activity_type", "status", "invoke_type", "start_time", "end_time", "date",
    "hour", "duration_seconds", "duration_minutes", "submitted_by", "created_by",
    "last_updated_by", "domain", "location", "object_url", "is_simulated", "failure_reason",
    "error_message", "error_code", "root_activity_id", "job_instance_id",
]

JOB_RENAMES = {
    "id": "job_instance_id",
    "startTimeUtc": "job_start_time",
    "endTimeUtc": "job_end_time",
    "status": "job_status",
    "failureReason": "job_failure_reason",
    "itemId": "item_id",
    "jobType": "job_type",
    "invokeType": "invoke_type",
    "rootActivityId": "root_activity_id",
}

TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX",
    "yyyy-MM-dd'T'HH:mm:ssX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
]

# -- fixed values: keyword rules, first match wins ----------------------------------
DOMAIN_RULES = [
    ("Human Resources", ["hr", "human", "resource"]),
    ("Finance", ["finance", "financial", "budget"]),
    ("Sales", ["sales", "crm", "customer"]),
    ("Operations", ["ops", "operation", "admin"]),
    ("IT", ["it", "tech", "system"]),
    ("Analytics", ["analytics", "bi", "data"]),
    ("Development", ["dev", "test", "prod"]),
]

LOCATION_RULES = [
    ("EMEA", ["emea"]),
    ("Americas", ["us", "usa", "america"]),
    ("APAC", ["apac", "asia", "pacific"]),
]

ENVIRONMENT_RULES = [
    ("DEV", ["dev", "[dev]", "-dev", "_dev", "development"]),
    ("TEST", ["test", "[test]", "-test", "_test", "testing", "qa"]),
    ("UAT", ["uat", "[uat]", "-uat", "_uat", "staging", "prj_uat", "prj uat"]),
    ("PRD", ["prd", "prod", "[prd]", "-prd", "_prd", "production", "live"]),
]

SYSTEM_USER_WORDS = ["system", "service", "app", "automation"]
GUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# -- fixed values: item types -------------------------------------------------------
ITEM_CATEGORIES = {
    "Compute": [
        "DataPipeline", "Pipeline", "Notebook", "SynapseNotebook", "SparkJobDefinition",
        "Dataflow", "DataFlow", "CopyJob",
    ],
    "Storage": [
        "Lakehouse", "Warehouse", "KQLDatabase", "KustoDatabase", "MirroredDatabase",
        "SnowflakeDatabase",
    ],
    "Analytics": [
        "KQLQueryset", "SemanticModel", "Dataset", "Report", "Dashboard", "Datamart",
    ],
    "Realtime": ["Eventstream", "Reflex"],
    "Infrastructure": ["Environment", "MLModel", "MLExperiment", "GraphQLApi"],
}

NATIVE_ITEM_TYPES = [
    "DataPipeline", "Pipeline", "Notebook", "SynapseNotebook", "SparkJobDefinition", "CopyJob",
    "Lakehouse", "Warehouse", "KQLDatabase", "KustoDatabase", "MirroredDatabase",
    "SnowflakeDatabase", "Eventstream", "Reflex", "Environment", "MLModel", "MLExperiment",
    "GraphQLApi", "KQLQueryset",
]

BI_ITEM_TYPES = [
    "Report", "Dashboard", "Dataset", "SemanticModel", "Dataflow", "DataFlow", "Datamart",
    "PaginatedReport",
]

PLATFORM_ITEM_TYPES = [t for types in ITEM_CATEGORIES.values() for t in types]

PLATFORM_OPERATIONS = [
    "RunArtifact", "ExecuteNotebook", "ExecutePipeline", "ExecuteSparkJob", "ExecuteDataflow",
    "ReadLakehouse", "WriteLakehouse",
]

COMPUTE_REPORT_TYPES = ["SparkJob", "Notebook", "DataPipeline", "SparkJobDefinition", "Lakehouse"]

OBJECT_URL_BASE = "https://app.powerbi.com"
OBJECT_URL_SEGMENTS = {
    "Report": "reports",
    "Dashboard": "dashboards",
    "SemanticModel": "datasets",
    "Dataset": "datasets",
    "Datamart": "datamarts",
    "Lakehouse": "lakehouses",
    "Warehouse": "warehouses",
    "DataPipeline": "datapipelines",
    "Pipeline": "datapipelines",
    "Notebook": "notebooks",
    "SynapseNotebook": "notebooks",
    "Dataflow": "dataflows",
    "DataFlow": "dataflows",
    "SparkJobDefinition": "sparkjobdefinitions",
    "CopyJob": "items",
    "KQLDatabase": "kqldatabases",
    "KustoDatabase": "kqldatabases",
    "KQLQueryset": "kqlquerysets",
    "Eventstream": "eventstreams",
    "MLModel": "mlmodels",
    "MLExperiment": "mlexperiments",
    "Environment": "environments",
    "MirroredDatabase": "mirroreddatabases",
    "SnowflakeDatabase": "items",
    "Reflex": "reflexes",
    "GraphQLApi": "graphqlapis",
}

# -- fixed values: activity types as (name, category, is_compute, is_native), keys 1.. in order
ACTIVITY_TYPES = [
    ("RenameFileOrDirectory", "File Operations", False, True),
    ("DeleteFile", "File Operations", False, True),
    ("DeleteFileOrBlob", "File Operations", False, True),
    ("CreateFile", "File Operations", False, True),
    ("MoveFile", "File Operations", False, True),
    ("CreateDirectory", "File Operations", False, True),
    ("SetFileProperties", "File Operations", False, True),
    ("ReadArtifact", "Artifact Operations", False, True),
    ("CreateArtifact", "Artifact Operations", False, True),
    ("UpdateArtifact", "Artifact Operations", False, True),
    ("DeleteArtifact", "Artifact Operations", False, True),
    ("ShareArtifact", "Artifact Operations", False, True),
    ("ExecutePipeline", "Compute", True, True),
    ("ExecuteNotebook", "Compute", True, True),
    ("ExecuteSparkJob", "Compute", True, True),
    ("ExecuteDataflow", "Compute", True, False),
    ("RunArtifact", "Compute", True, True),
    ("CancelRunningArtifact", "Compute", False, True),
    ("StartRunNotebook", "Compute", True, True),
    ("StopNotebookSession", "Compute", False, True),
    ("ConfigureNotebook", "Compute", False, True),
    ("Pipeline", "Compute", True, True),
    ("PipelineRunNotebook", "Compute", True, True),
    ("Refresh", "Compute", True, True),
    ("Publish", "Compute", True, True),
    ("RunNotebookInteractive", "Compute", True, True),
    ("DataflowGen2", "Compute", True, True),
    ("SparkJob", "Compute", True, True),
    ("ScheduledNotebook", "Compute", True, True),
    ("OneLakeShortcut", "Compute", True, True),
    ("ViewSparkAppLog", "Spark", False, True),
    ("ViewSparkApplication", "Spark", False, True),
    ("ViewSparkAppInputOutput", "Spark", False, True),
    ("LoadSparkAppLog", "Spark", False, True),
    ("LivySparkSessionAcquired", "Spark", True, True),
    ("LivySparkSessionCancelled", "Spark", False, True),
    ("CreateCheckpoint", "Spark", False, True),
    ("MountStorageByMssparkutils", "Spark", False, True),
    ("ReadLakehouse", "Lakehouse", False, True),
    ("WriteLakehouse", "Lakehouse", False, True),
    ("ListLakehouseTables", "Lakehouse", False, True),
    ("GetLakehouseTableDetails", "Lakehouse", False, True),
    ("PreviewLakehouseTable", "Lakehouse", False, True),
    ("LoadLakehouseTable", "Lakehouse", False, True),
    ("DeleteLakehouseTable", "Lakehouse", False, True),
    ("GetDataArtifactTableDetails", "Lakehouse", False, True),
    ("CreateShortcut", "Shortcut", False, True),
    ("DeleteShortcut", "Shortcut", False, True),
    ("ExecuteKQLQuery", "Query", True, True),
    ("ExecuteSQLQuery", "Query", True, True),
    ("ConnectWarehouseAndSqlAnalyticsEndpointLakehouseFromExternalApp", "Query", False, True),
    ("CreateSqlQueryFromWarehouse", "Query", False, True),
    ("CreateVisualQueryFromWarehouse", "Query", False, True),
    ("DeleteSavedQueryFromWarehouse", "Query", False, True),
    ("GetArtifactSqlAuditConfiguration", "Query", False, True),
    ("CreateWorkspace", "Admin", False, True),
    ("UpdateWorkspace", "Admin", False, True),
    ("DeleteWorkspace", "Admin", False, True),
    ("AddWorkspaceUser", "Admin", False, True),
    ("StartPublishEnvironment", "Environment", False, True),
    ("FinishPublishEnvironment", "Environment", False, True),
    ("ReadEnvironmentResource", "Environment", False, True),
    ("UpdateEnvironmentSparkSettings", "Environment", False, True),
    ("DeleteModelEndpoint", "ML", False, True),
    ("RequestCopilot", "ML", False, True),
    ("SensitivityLabelApplied", "Security", False, True),
    ("SensitivityLabelChanged", "Security", False, True),
    ("ViewReport", "Analytics", False, False),
    ("RefreshDataset", "Compute", True, False),
]
UNKNOWN_ACTIVITY_TYPE_SK = 999

# -- fixed values: statuses as (code, category, is_terminal, severity), keys 1.. in order
STATUSES = [
    ("Succeeded", "Success", True, 0),
    ("Completed", "Success", True, 0),
    ("Failed", "Failure", True, 2),
    ("Cancelled", "Failure", True, 1),
    ("InProgress", "Pending", False, 0),
    ("Running", "Pending", False, 0),
    ("Queued", "Pending", False, 0),
    ("Unknown", "Unknown", True, 1),
]
UNKNOWN_STATUS_SK = 8

FAILED_STATUSES = ["failed", "cancelled", "error"]
SUCCESS_STATUSES = ["succeeded", "completed", "success"]

# -- fixed values: thresholds -------------------------------------------------------
LONG_RUNNING_SECONDS = 3600
FAILURE_THRESHOLD_PERCENT = 20
EXCESS_ACTIVITY_THRESHOLD = 50
ASOF_TOLERANCE_SECONDS = 300
DEFAULT_PERIOD_DAYS = 90
RETENTION_DAYS = 180
EMPTY_CAPACITY_ID = "00000000-0000-0000-0000-000000000000"

# -- fixed values: report colours ---------------------------------------------------
GREEN, YELLOW, RED = "#107C10", "#FFB900", "#E81123"
TREND_UP, TREND_DOWN, TREND_FLAT = "▲", "▼", "―"

# -- fixed values: measure categories that the activity-type measures ask for --------
MEASURE_CATEGORIES = ["Pipeline", "Notebook", "Dataflow", "Lakehouse", "SemanticModel", "Report"]

# -- fixed values: external source kinds --------------------------------------------
EXTERNAL_SOURCE_TYPES = [
    "AdlsGen2", "AzureBlob", "AmazonS3", "OneDriveSharePoint", "Snowflake", "GoogleCloudStorage",
]
TABLE_FILE_EXTENSIONS = [".parquet", ".csv", ".delta", ".json"]
