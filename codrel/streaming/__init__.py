"""The engine has no streaming operators: relations and vectors are bounded."""
