"""End-to-end jobs, one function per report."""
