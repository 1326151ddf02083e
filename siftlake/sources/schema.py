"""Event classes of the canonical schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Event classes by the first class_uid of their range, in order.
RANGES = {
    1001: "file_activity kernel_extension kernel_activity memory_activity module_activity scheduled_job_activity process_activity",
    2001: "security_finding vulnerability_finding compliance_finding detection_finding incident_finding",
    3001: "account_change authentication authorize_session entity_management user_access_management group_management",
    4001: "network_activity http_activity dns_activity dhcp_activity rdp_activity smb_activity ssh_activity ftp_activity email_activity "
    "network_file_activity email_file_activity email_url_activity ntp_activity tunnel_activity",
    6001: "web_resource_access_activity application_lifecycle api_activity web_resource_activity datastore_activity file_hosting_activity scan_activity",
}
CLASS_UID = {key: first + k for first, keys in RANGES.items() for k, key in enumerate(keys.split())}


def event_classes(spark: SparkSession) -> DataFrame:
    """The 39 classes: class_uid, key, name."""
    return spark.createDataFrame([(uid, key, key.replace("_", " ").title()) for key, uid in CLASS_UID.items()], "class_uid int, key string, name string")
