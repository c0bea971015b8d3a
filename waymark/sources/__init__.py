"""Layer scans, geometry preparation, file manifests and the place taxonomy."""
