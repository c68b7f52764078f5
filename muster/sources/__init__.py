"""Sources: files, a SOAP service and a REST service."""
