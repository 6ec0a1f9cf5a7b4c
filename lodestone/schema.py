"""Tables, enum domains and default thresholds."""

from __future__ import annotations

RUN = ["project_id", "analysis_number"]
#: Column types of the model tables, all of which also carry RUN.
TABLES = {
    "microservices": "project_id long, analysis_number int, id long, name string, relative_path string, lines_of_code int, number_of_classes int, number_of_endpoints int, number_of_entities int, datasource_url string, datasource_name string, detection_confidence string, detection_signal string",
    "endpoints": "project_id long, analysis_number int, microservice_id long, path string, http_method string, controller_class string, method_name string, api_version string, has_versioning boolean",
    "service_dependencies": "project_id long, analysis_number int, id long, source_service_id long, target_service_id long, dependency_type string, call_count int, evidence_file string, evidence_line int, evidence_code string, target_url string",
    "code_smells": "project_id long, analysis_number int, microservice_id long, smell_type string, description string, file_path string, class_name string, method_name string, line_number int, severity string, source_tool string",
    "analysis_jobs": "id long, project_id long, analysis_number int, status string, created_at timestamp_ntz, services_completed int, total_services int",
}
# Domains and weights that results depend on.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
PENALTY = {"CRITICAL": 8, "HIGH": 5, "MEDIUM": 3, "LOW": 1}
DEPENDENCY_TYPES = ["FEIGN_CLIENT", "REST_TEMPLATE", "WEB_CLIENT"]
ACTIVE = ["PENDING", "CLONING", "DETECTING_SERVICES", "ANALYZING_SERVICES", "BUILDING_GRAPH", "DETECTING_PATTERNS"]
DEFAULTS = {
    "nano_max_loc": 500, "nano_max_endpoints": 2, "chatty_min_calls": 5, "esb_mediator": 0.4, "smell_density": 80,
    "god_fields": 25, "god_methods": 30, "god_loc": 1000, "god_domains": 20, "god_ctor_params": 12, "god_tcc": 0.5, "god_min_metrics": 3,
    "monolith_coupling": 0.5, "monolith_connected": 0.8, "monolith_moderate": 0.3,
}


def option(config: dict | None, name: str):
    """Value of an option: the run's own if it is set, else the default."""
    value = (config or {}).get(name)
    return DEFAULTS[name] if value is None else value
