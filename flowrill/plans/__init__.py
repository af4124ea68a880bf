"""Multi-step jobs and the catalogue of registered queries."""
